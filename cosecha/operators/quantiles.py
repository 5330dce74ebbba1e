"""Exact per-group quantiles by sketch, bracket and selection, one method at every size.

The result equals Spark's ``percentile`` (linear interpolation between the
order statistics at floor and ceil of (n - 1)·p), but no task ever holds a
group's values:

1. one aggregate keeps a KLL sketch for each group and column (merged
   map-side, of bounded size), with n, minimum and maximum;
2. the sketch brackets each wanted rank between two values, with a margin of
   several times its error; a group of up to ``SKETCH`` rows is its own bracket;
3. one more aggregate counts the rows below each bracket and each distinct
   value inside it, a small share of a large group;
4. a running sum over these counts, streamed in order, gives the values at
   the wanted ranks exactly.

A bracket that misses its rank (beyond ten standard deviations) is found by
the counts and taken again over the whole range.  NULL is a group like any
other, columns may have any names, and nothing runs while the plan is built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SKETCH = 1024  # KLL's k
MARGIN = 4 * 2.446 / SKETCH ** 0.9433  # four times the 99 % rank error published for such a sketch


def null_safe(left: str, right: str, pairs: list[tuple[str, str]]) -> Column:
    """``left`` and ``right`` (aliases) agree on the paired columns; NULL equals NULL."""
    cond = F.lit(True)
    for a, b in pairs:
        cond = cond & F.col(f"{left}.`{a}`").eqNullSafe(F.col(f"{right}.`{b}`"))
    return cond


def join_groups(df: DataFrame, stats: DataFrame, group: list[str], how: str = "left") -> DataFrame:
    """``df`` with the columns of ``stats`` for its group; NULL keys meet NULL keys."""
    extra = [c for c in stats.columns if c not in group]
    return (df.alias("l").join(stats.alias("r"), null_safe("l", "r", [(g, g) for g in group]), how)
            .select(*[F.col(f"l.`{c}`").alias(c) for c in df.columns], *[F.col(f"r.`{c}`").alias(c) for c in extra]))


def _selected(rows: DataFrame, brackets: DataFrame, keys: list[str], n_targets: int) -> DataFrame:
    """(keys, t, at_lo, at_hi): the values at each target's two ranks, NULL where its bracket misses them.

    ``rows`` has the keys and an array ``v`` with each target's value;
    ``brackets`` has the keys and an array ``b`` of (lo, hi, from, to).
    """
    pairs = rows.alias("l").join(brackets.alias("r"), null_safe("l", "r", [(k, k) for k in keys]))
    cells = F.array(*[F.struct(F.lit(t).alias("t"), F.col("l.v")[t].alias("v"), F.col("r.b")[t].alias("b"))
                      for t in range(n_targets)])
    cells = pairs.select(*[F.col(f"l.`{k}`").alias(k) for k in keys], F.explode(cells).alias("c"))
    cells = cells.where(F.col("c.v").isNotNull() & F.col("c.b").isNotNull() & (F.col("c.v") <= F.col("c.b.to")))
    value = F.when(F.col("c.v") >= F.col("c.b.from"), F.col("c.v"))  # NULL: below the bracket
    counts = cells.select(*keys, F.col("c.t").alias("t"), F.col("c.b.lo").alias("lo"), F.col("c.b.hi").alias("hi"),
                          value.alias("value")).groupBy(*keys, "t", "lo", "hi", "value").agg(F.count("*").alias("n"))
    up_to = F.sum("n").over(Window.partitionBy(*keys, "t").orderBy(F.col("value").asc_nulls_first())
                            .rowsBetween(Window.unboundedPreceding, 0))
    counts = counts.withColumn("up_to", up_to)
    at = lambda r: F.max(F.when((F.col("up_to") > F.col(r)) & (F.col("up_to") - F.col("n") <= F.col(r)),
                                F.col("value")))
    return counts.groupBy(*keys, "t", "lo", "hi").agg(at("lo").alias("at_lo"), at("hi").alias("at_hi"))


def quantiles(df: DataFrame, wanted: dict[str, tuple[str, float]], group: list[str],
              margin: float = MARGIN, sketch: int = SKETCH) -> DataFrame:
    """(group..., <name> for each (column, p) of ``wanted``), one row per group of ``df``.

    A name is NULL for a group without a value in its column.  NaN counts as
    the largest value.  ``group`` may be empty: one row over all.
    """
    keys = [f"k{i}" for i in range(len(group))] or ["k0"]
    columns = sorted({c for c, _ in wanted.values()})
    own = [F.col(f"`{g}`").alias(k) for g, k in zip(group, keys)] or [F.lit(0).alias("k0")]
    rows = df.select(*own, *[F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(columns)])
    targets = [(columns.index(c), p) for c, p in wanted.values()]
    # 1. sketches
    aggs = []
    for i in range(len(columns)):
        x = F.col(f"x{i}")
        aggs += [F.count(x).alias(f"n{i}"), F.count_if(F.isnan(x)).alias(f"nan{i}"), F.min(x).alias(f"min{i}"),
                 F.max(x).alias(f"max{i}"),
                 F.kll_sketch_agg_double(F.nullif(x, F.lit(float("nan"))), F.lit(sketch)).alias(f"s{i}")]
    stats = rows.groupBy(*keys).agg(*aggs)
    # 2. brackets

    def bracket(i: int, p: float) -> Column:
        n, whole = F.col(f"n{i}"), (F.col(f"n{i}") <= sketch) | (F.col(f"nan{i}") > 0)
        place = (n - 1) * F.lit(p)
        edge = lambda q, end: F.when(whole, F.col(f"{end}{i}")).otherwise(
            F.kll_sketch_get_quantile_double(f"s{i}", F.lit(min(1.0, max(0.0, q)))))
        low = edge(p - margin, "min") if p > margin else F.col(f"min{i}")
        high = edge(p + margin, "max") if p < 1 - margin else F.col(f"max{i}")
        return F.when(n > 0, F.struct(F.floor(place).cast("long").alias("lo"), F.ceil(place).cast("long").alias("hi"),
                                      low.alias("from"), high.alias("to")))

    brackets = stats.select(*keys, F.array(*[bracket(i, p) for i, p in targets]).alias("b"))
    # 3. and 4. counts and selection
    values = rows.select(*keys, F.array(*[F.col(f"x{i}") for i, _ in targets]).alias("v"))
    found = _selected(values, brackets, keys, len(targets))
    missed = F.col("at_lo").isNull() | F.col("at_hi").isNull()
    again = found.where(missed).groupBy(*keys).agg(F.lit(1).alias("one"))
    whole_range = F.array(*[F.when(F.col(f"r.n{i}") > 0, F.struct(
        F.floor((F.col(f"r.n{i}") - 1) * F.lit(p)).cast("long").alias("lo"),
        F.ceil((F.col(f"r.n{i}") - 1) * F.lit(p)).cast("long").alias("hi"),
        F.col(f"r.min{i}").alias("from"), F.col(f"r.max{i}").alias("to"))) for i, p in targets])
    again = (again.alias("l").join(stats.alias("r"), null_safe("l", "r", [(k, k) for k in keys]))
             .select(*[F.col(f"l.{k}").alias(k) for k in keys], whole_range.alias("b")))
    exact = found.where(~missed).unionByName(_selected(values, again, keys, len(targets)))
    # Interpolated as ``percentile`` does it.
    per = exact.groupBy(*keys, "t").agg(F.max("lo").alias("lo"), F.max("hi").alias("hi"),
                                        F.max("at_lo").alias("at_lo"), F.max("at_hi").alias("at_hi"))
    got = per.groupBy(*keys).agg(*[F.max(F.when(F.col("t") == t, F.struct("at_lo", "at_hi"))).alias(f"q{t}")
                                   for t in range(len(targets))])
    out = stats.alias("l").join(got.alias("r"), null_safe("l", "r", [(k, k) for k in keys]), "left")

    def value(t: int, i: int, p: float) -> Column:
        place = (F.col(f"l.n{i}") - 1) * F.lit(p)
        lo, hi = F.col(f"r.q{t}.at_lo"), F.col(f"r.q{t}.at_hi")
        return F.when(lo == hi, lo).otherwise((F.ceil(place) - place) * lo + (place - F.floor(place)) * hi)

    return out.select(*[F.col(f"l.{k}").alias(g) for g, k in zip(group, keys)],
                      *[value(t, i, p).alias(name) for t, ((i, p), name) in enumerate(zip(targets, wanted))])


def group_quantiles(df: DataFrame, value: str, group: list[str], probs: dict[str, float]) -> DataFrame:
    """(group..., <name> for each p) of one column, for the groups that have a value."""
    return quantiles(df.filter(F.col(f"`{value}`").isNotNull()), {n: (value, p) for n, p in probs.items()}, group)


def group_medians(df: DataFrame, cols: list[str], group: list[str], prefix: str = "_med_") -> DataFrame:
    """(group..., <prefix><column>) of several columns."""
    return quantiles(df, {f"{prefix}{c}": (c, 0.5) for c in cols}, group)
