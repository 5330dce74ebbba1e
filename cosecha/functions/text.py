"""String functions (X-s1 … X-s9, X-a1) as built-in Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import col_

# Accent folding table (source characters and their targets).
ACCENTED = "áéíóúüñÁÉÍÓÚÜÑ"
FOLDED = "aeiouunaeiouun"

# Spanish month names, in calendar order (1..12).
MONTHS_ES = ["enero", "febrero", "marzo", "abril", "mayo", "junio", "julio",
             "agosto", "septiembre", "octubre", "noviembre", "diciembre"]
# Three-letter month labels used in period labels (1..12).
MONTHS_ABBR = ["Ene", "Feb", "Mar", "Abr", "May", "Jun", "Jul", "Ago", "Sep", "Oct", "Nov", "Dic"]


def fold_accents(c) -> Column:
    """Lower-case and strip Spanish accents (X-s2)."""
    return F.lower(F.translate(col_(c), ACCENTED, FOLDED))


def like_contains_ci(c, pattern: str) -> Column:
    """UPPER(c) LIKE UPPER('%pattern%') without wildcard interpretation."""
    return F.upper(col_(c)).contains(pattern.upper())


def zfill(c, width: int = 2) -> Column:
    """Left zero padding that never truncates longer values (X-s5).

    ``lpad`` cuts strings longer than the width, Python's zfill does not.
    """
    s = col_(c).cast("string")
    return F.when(F.length(s) >= width, s).otherwise(F.lpad(s, width, "0"))


def fmt_thousands(c, decimals: int = 0, compat: bool = True) -> Column:
    """Spanish-style number text (X-s7).

    ``compat=True`` follows the reference: Python ``f"{x:,.Nf}"`` then every
    "," becomes ".", so 1234.567 with 3 decimals prints 1.234.567.  Otherwise
    the proper form with a decimal comma (1.234,567).  ``format_number`` rounds
    HALF_EVEN like Python's formatting.
    """
    s = F.format_number(col_(c), decimals)
    if compat:
        return F.replace(s, F.lit(","), F.lit("."))
    return F.translate(s, ",.", ".,")


def fmt_fixed(c, decimals: int = 2) -> Column:
    """Python ``f"{x:.2f}"`` (no grouping)."""
    return F.replace(F.format_number(col_(c), decimals), F.lit(","), F.lit(""))


def safe_id(base) -> Column:
    """Fragment id: cleaned base key + "_" + first 8 hex digits of md5(base) (X-s8).

    Cleaning strips the ends, "/" becomes "-" and " " becomes "_".
    """
    b = col_(base)
    clean = F.replace(F.replace(F.trim(b), F.lit("/"), F.lit("-")), F.lit(" "), F.lit("_"))
    return F.concat(clean, F.lit("_"), F.substring(F.md5(b), 1, 8))


def period_label_month(anio, mes) -> Column:
    """``YYYY-Mon`` label (X-s6)."""
    labels = F.array(*[F.lit(m) for m in MONTHS_ABBR])
    return F.concat_ws("-", col_(anio).cast("string"), F.element_at(labels, col_(mes).cast("int")))


def period_label_week(anio, semana) -> Column:
    """``YYYY-Sww`` label (X-s6)."""
    return F.concat(col_(anio).cast("string"), F.lit("-S"), zfill(semana, 2))


def title_case(c) -> Column:
    """Every run of letters with a capital first and small letters behind (X-s1): "ARABA/ÁLAVA" is "Araba/Álava"."""
    runs = F.regexp_extract_all(F.lower(col_(c)), F.lit(r"(\p{L}+|[^\p{L}]+)"), 1)
    return F.array_join(F.transform(runs, F.initcap), "")


def year_range(c, pattern: str = r"20\d{2}") -> list[Column]:
    """min / max / count of the years found in a text (X-s4)."""
    found = F.transform(F.regexp_extract_all(col_(c), F.lit(pattern), 1), lambda x: x.cast("int"))
    return [F.array_min(found).alias("anio_min"), F.array_max(found).alias("anio_max"),
            F.size(found).alias("n_anios")]


# Prefixes removed before taking a community's first word.
COMMUNITY_PREFIXES = ["Comunitat ", "Comunidad de ", "Región de ", "Islas ", "La "]


def community_keyword(c) -> Column:
    """First word of a community name after removing fixed prefixes (X-s9)."""
    s = col_(c)
    for p in COMMUNITY_PREFIXES:
        s = F.replace(s, F.lit(p), F.lit(""))
    return F.split(s, " ")[0]
