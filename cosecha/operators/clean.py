"""Cleaning operators (C1-C3, C11, C12), lookups (I8, I17-I19), P1, X-c3.

In-place UPDATEs of the reference become expression rewrites producing a new
DataFrame; nothing is mutated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..dims import UNKNOWN_CCAA
from ..functions.numeric import round_half_up, safe_div


def null_negatives(df: DataFrame, cols: list[str]) -> DataFrame:
    """Negative measures become NULL."""
    return df.withColumns({c: F.when(F.col(c) < 0, F.lit(None)).otherwise(F.col(c)) for c in cols})


def negative_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """How many values ``null_negatives`` changes, in one pass."""
    return df.agg(*[F.count_if(F.col(c) < 0).alias(f"{c}_negativos") for c in cols])


def null_bad_price(df: DataFrame, col: str = "precio_sem_actual") -> DataFrame:
    """Non-positive prices become NULL."""
    return df.withColumn(col, F.when(F.col(col) <= 0, F.lit(None)).otherwise(F.col(col)))


def recompute_variation(df: DataFrame, null_stale: bool = False) -> DataFrame:
    """Weekly variation % recomputed where both prices exist.

    Elsewhere the stored value is kept (trap Q13); ``null_stale=True`` clears it.
    """
    act, ant = F.col("precio_sem_actual"), F.col("precio_sem_anterior")
    both = act.isNotNull() & ant.isNotNull()
    fresh = round_half_up(safe_div(act - ant, ant) * 100, 2)
    other = F.lit(None).cast("double") if null_stale else F.col("variacion_pct")
    return df.withColumn("variacion_pct", F.when(both, fresh).otherwise(other))


def lookup_ccaa(df: DataFrame, code_col: str, mapping: DataFrame, out: str = "ccaa_ine") -> DataFrame:
    """Code → community with the "DESCONOCIDA" default (I8).

    ``mapping`` is the fixed 50-row (cod, ccaa_map) table, broadcast.
    """
    j = df.join(F.broadcast(mapping), F.col(code_col) == F.col("cod"), "left")
    return j.select(*[F.col(c) for c in df.columns],
                    F.coalesce(F.col("ccaa_map"), F.lit(UNKNOWN_CCAA)).alias(out))


def map_to_code(df: DataFrame, name_col: str, dictionary: DataFrame, out: str) -> DataFrame:
    """Map a free-text name to a code through a dictionary on upper(trim()).

    ``dictionary`` has columns (nombre, cod); unmapped names give NULL.  The
    dictionary is de-duplicated by key first, so the join cannot multiply rows.
    """
    d = (dictionary.select(F.upper(F.trim("nombre")).alias("_k"), F.col("cod"))
         .groupBy("_k").agg(F.min("cod").alias(out)))
    j = df.join(d, F.upper(F.trim(F.col(name_col))) == F.col("_k"), "left")
    return j.drop("_k")


def first_n_stations(stations: DataFrame, n: int) -> DataFrame:
    """First n mapped stations by province code, station id as tie-break."""
    return (stations.filter(F.col("cod_provincia").isNotNull())
            .orderBy("cod_provincia", "indicativo").limit(n))


def missing_coverage(stations: DataFrame, present: DataFrame, a0: int, a1: int) -> DataFrame:
    """(station, year) pairs of the request grid with no data.

    Each station expands to the bounded year list ``a0..a1`` (a parameter,
    not data), then an anti join removes the pairs that have rows.
    """
    grid = stations.select("indicativo", F.explode(F.sequence(F.lit(a0), F.lit(a1))).alias("anio"))
    have = present.select("indicativo", "anio").distinct()
    return grid.join(have, ["indicativo", "anio"], "left_anti").select(
        "indicativo", F.col("anio").cast("int").alias("anio"))


def rename_present(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Select and rename the mapped columns that exist."""
    return df.select(*[F.col(c).alias(n) for c, n in mapping.items() if c in df.columns])


def usable_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """Which candidate columns hold any non-NULL value (X-c3), one pass."""
    wide = df.agg(*[F.bool_or(F.col(c).isNotNull()).alias(c) for c in cols])
    return wide.unpivot([], cols, "columna", "tiene_datos")


def assert_ready(df: DataFrame, required: list[str], no_nulls: list[str] | None = None) -> DataFrame:
    """Precondition gate (C12): raise if columns are missing or features hold NULLs.

    The NULL check is one aggregate; only its single result row reaches the
    driver.
    """
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"columnas requeridas ausentes: {missing}")
    if no_nulls:
        row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in no_nulls]).first()
        bad = {c: row[c] for c in no_nulls if row[c]}
        if bad:
            raise ValueError(f"columnas con NULL: {bad}")
    return df
