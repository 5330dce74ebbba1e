"""Parsing of raw text cells into typed values (I1-I7, I13, I16, X-j1).

All are Column expressions (JVM side, inside whole-stage codegen); none needs
a Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dims import CCAA_NAMES, UNIPROV_CODES
from .numeric import col_
from .text import title_case

# Python's float() grammar for plain decimal numbers (digits may be grouped by
# single underscores).  Java's parser accepts things Python rejects ("1d",
# "0x1p3"), so strings are checked against this first.
PY_FLOAT_RE = r"^[+-]?((\d(_?\d)*)(\.(\d(_?\d)*)?)?|\.\d(_?\d)*)([eE][+-]?\d(_?\d)*)?$"
PY_SPECIAL_RE = r"^[+-]?(nan|inf|infinity)$"

# Tokens that mean "no value".
EU_NULL_TOKENS = ("-", "—", "–", "")
CLIMATE_NULL_TOKENS = ("", "Ip", "Varias", "Acum")

FILENAME_RE = r"cuaderno_(\w+?)(\d{4})"
CODE_NAME_RE = r"^(\d{1,2})\s+(.+)"
PRODUCT_UNIT_RE = r"\((€[^)]+)\)\s*\*?\s*$"


def strip_ws(c) -> Column:
    """Python ``str.strip()`` for ASCII whitespace."""
    return F.regexp_replace(col_(c), r"^\s+|\s+$", "")


def py_float(c) -> Column:
    """``float(str(x))`` or NULL, with Python's acceptance rules."""
    s = strip_ws(c)
    ok = s.rlike(PY_FLOAT_RE) | F.lower(s).rlike(PY_SPECIAL_RE)
    return F.when(ok, F.replace(s, F.lit("_"), F.lit("")).try_cast("double"))


def py_int(c) -> Column:
    """``int(float(x))``: truncation toward zero."""
    return py_float(c).try_cast("bigint")


def float_eu(c) -> Column:
    """Decimal-comma number (I4): dash tokens and "" are NULL, every "," → "."."""
    s = strip_ws(c)
    return F.when(~s.isin(*EU_NULL_TOKENS), py_float(F.replace(s, F.lit(","), F.lit("."))))


def float_climate(c, trace_as_zero: bool = False) -> Column:
    """Weather-service number (I5): "Ip", "Varias", "Acum", "" are NULL.

    "Ip" marks trace precipitation; ``trace_as_zero=True`` reads it as 0.0
    instead of NULL, which keeps it out of the NULL imputation (trap Q11).
    """
    s = strip_ws(c)
    parsed = F.when(~s.isin(*CLIMATE_NULL_TOKENS), py_float(F.replace(s, F.lit(","), F.lit("."))))
    return F.when(s == "Ip", F.lit(0.0)).otherwise(parsed) if trace_as_zero else parsed


def coerce_numeric(c) -> Column:
    """``pd.to_numeric(errors="coerce")``."""
    return py_float(c)


def parse_period(df: DataFrame, path_col: str, months: DataFrame) -> DataFrame:
    """Period from a file name (I1): ``cuaderno_<month><yyyy>`` on the lower-cased stem.

    Adds ``mes``, ``anio``, ``mes_nombre`` and ``error`` (NULL when parsed).
    ``months`` is the fixed 12-row month table (broadcast).
    """
    stem = F.lower(F.regexp_replace(F.element_at(F.split(col_(path_col), "/"), -1), r"\.[^.]*$", ""))
    name = F.regexp_extract(stem, FILENAME_RE, 1)
    year = F.regexp_extract(stem, FILENAME_RE, 2)
    matched = stem.rlike(FILENAME_RE)
    out = (df.withColumn("_mes_str", F.when(matched, name))
           .withColumn("_anio_str", F.when(matched, year))
           .join(months.withColumnRenamed("mes_nombre", "_mes_str"), "_mes_str", "left"))
    err = (F.when(~matched, F.lit("nombre no reconocido"))
           .when(F.col("mes").isNull(), F.lit("mes no reconocido")))
    return (out.withColumn("anio", F.when(F.col("mes").isNotNull(), F.col("_anio_str").cast("int")))
            .withColumn("mes_nombre", F.when(F.col("mes").isNotNull(), F.col("_mes_str")))
            .withColumn("error", err)
            .drop("_mes_str", "_anio_str"))


def classify_row(c) -> Column:
    """Row type from the column-0 cell (I7): struct(tipo, cod, nombre).

    Ordered rules: NULL / empty / "(" / "*" → skip; contains ESPAÑA → total;
    contains "SUMA PROV" → skip; "<1-2 digits> <name>" → uniprov or provincia;
    upper-case name in the community set → ccaa; otherwise skip.
    """
    s = strip_ws(c)
    up = F.upper(s)
    code = F.regexp_extract(s, CODE_NAME_RE, 1).cast("int")
    name = strip_ws(F.regexp_extract(s, CODE_NAME_RE, 2))
    is_code = s.rlike(CODE_NAME_RE)
    skip = col_(c).isNull() | (s == "") | s.startswith("(") | s.startswith("*")
    tipo = (F.when(skip, "skip")
            .when(up.contains("ESPAÑA"), "total")
            .when(up.contains("SUMA PROV"), "skip")
            .when(is_code & code.isin(*sorted(UNIPROV_CODES)), "uniprov")
            .when(is_code, "provincia")
            .when(strip_ws(up).isin(*sorted(CCAA_NAMES)), "ccaa")
            .otherwise("skip"))
    cod = F.when(tipo.isin("uniprov", "provincia"), code)
    nombre = (F.when(tipo == "total", F.lit("ESPAÑA"))
              .when(tipo.isin("uniprov", "provincia"), name)
              .when(tipo == "ccaa", s))
    return F.struct(tipo.alias("tipo"), cod.alias("cod"), nombre.alias("nombre"))


def split_product_unit(c) -> Column:
    """(name, unit) from "Name (€/unit) *" (I13); no unit → (whole text, "")."""
    raw = strip_ws(c)
    has = raw.rlike(PRODUCT_UNIT_RE)
    unit = strip_ws(F.regexp_extract(raw, PRODUCT_UNIT_RE, 1))
    before = F.regexp_replace(raw, PRODUCT_UNIT_RE, "")
    name = strip_ws(F.regexp_replace(strip_ws(before), r"\*+$", ""))
    return F.struct(F.when(has, name).otherwise(raw).alias("nombre"),
                    F.when(has, unit).otherwise(F.lit("")).alias("unidad"))


def normalise_climate(df: DataFrame, fecha: str = "fecha") -> DataFrame:
    """Split "YYYY-M" (I16): exactly two integer parts, else the row is dropped."""
    parts = F.split(F.col(fecha), "-")
    anio = strip_ws(parts[0]).try_cast("int")
    mes = strip_ws(parts[1]).try_cast("int")
    ok = (F.size(parts) == 2) & parts[0].rlike(r"^\s*[+-]?\d+\s*$") & parts[1].rlike(r"^\s*[+-]?\d+\s*$")
    return df.filter(ok).withColumn("anio", anio).withColumn("mes", mes)



# Anomaly-request defaults.
REQUEST_DEFAULTS = {"anio_ini": 2014, "anio_fin": 2025, "metodo": "ambos"}
REQUEST_SCHEMA = "cultivo string, provincia string, anio_ini int, anio_fin int, metodo string"
LOOSE_FIELD_RE = r'(?iu){f}["\s:=]+([A-ZÁÉÍÓÚÜÑ\s]+)'


def parse_params(c) -> Column:
    """Anomaly request (X-j1): JSON object, or loose "campo: valor" text.

    Valid JSON is read with ``from_json``; otherwise ``cultivo`` and
    ``provincia`` come from a regex over the text (crop upper-cased,
    province title-cased).  Missing fields take the fixed defaults.
    """
    js = F.from_json(col_(c), REQUEST_SCHEMA)
    is_json = F.get_json_object(col_(c), "$").isNotNull()

    def loose(f):
        v = strip_ws(F.regexp_extract(col_(c), LOOSE_FIELD_RE.format(f=f), 1))
        return F.when(v != "", v)
    cultivo = F.when(is_json, js["cultivo"]).otherwise(F.upper(loose("cultivo")))
    provincia = F.when(is_json, js["provincia"]).otherwise(loose("provincia"))
    return F.struct(
        F.upper(strip_ws(F.coalesce(cultivo, F.lit("")))).alias("cultivo"),
        title_case(strip_ws(F.coalesce(provincia, F.lit("")))).alias("provincia"),
        F.coalesce(F.when(is_json, js["anio_ini"]), F.lit(REQUEST_DEFAULTS["anio_ini"])).alias("anio_ini"),
        F.coalesce(F.when(is_json, js["anio_fin"]), F.lit(REQUEST_DEFAULTS["anio_fin"])).alias("anio_fin"),
        F.coalesce(F.when(is_json, js["metodo"]), F.lit(REQUEST_DEFAULTS["metodo"])).alias("metodo"))
