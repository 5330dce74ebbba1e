"""Numeric helpers shared by the operators (X-m1, X-m3, X-c1)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed unit rule: yield kg/ha = production (thousand tonnes) / area (ha) x 1e6
KG_PER_THOUSAND_T = 1_000_000.0


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_half_up(c, digits: int) -> Column:
    """ROUND half away from zero on the decimal value of ``c``.

    Rounding a double directly depends on its binary expansion (0.285 is
    0.28499…), so engines disagree at ties.  Its decimal value to about 15
    significant digits, all that a double holds, is what a person computing by
    hand would round, and does not depend on the last bits of a sum.
    """
    x = col_(c)
    size = F.abs(x)

    def rounded(scale: int) -> Column:
        return F.round(x.try_cast(f"decimal(38,{scale})"), digits).cast("double")

    out = F.when(size < 1, rounded(15))
    for power, scale in ((10, 14), (100, 13), (1000, 12)):
        out = out.when(size < power, rounded(scale))
    out = out.otherwise(rounded(9))
    # Beyond the decimal's range, and for NaN and infinity, there is nothing to round.
    return F.coalesce(out, x.cast("double"))


def safe_div(a, b) -> Column:
    """a / NULLIF(b, 0): NULL instead of an ANSI division error."""
    return F.try_divide(col_(a), F.nullif(col_(b), F.lit(0)))


def yield_kg_ha(prod, sup) -> Column:
    """Yield in kg/ha from production (thousand t) and area (ha)."""
    return safe_div(prod, sup) * F.lit(KG_PER_THOUSAND_T)
