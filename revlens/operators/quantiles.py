"""Exact quantiles from mergeable sketches: two scans for any table of some billion rows.

The first scan builds one quantile sketch per group and column in the tasks that read the
rows, and merges them. A sketch of accuracy ACCURACY is off by at most 1/ACCURACY of the rows,
so two of its values, a little below and a little above a wanted rank, surely enclose it. The
second scan counts the rows below such a bracket and the distinct values inside. Only where a
bracket may hold more than BRACKET rows is it narrowed first, by a sketch of the rows inside.
Brackets reach the tasks as a small table; rows are neither shuffled nor sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revlens.sources.sinks import stored

ACCURACY = 10_000
#: Rows of a bracket that are counted by value and put in order.
BRACKET = 1_000_000
# Groups times value columns whose brackets are sent to every task; more are joined by shuffle.
SENT_GROUPS = 10_000
#: Distances from a wanted rank, as shares of the rows, from which a sketch surely lies beyond it
#: (by its error and the three rows that rounding may cost), and the least rows for each.
_SLACK = ((2 / ACCURACY, 3 * ACCURACY), (1 / 64, 256))


def _sketch(rows: DataFrame, keys: list[str], probabilities: Sequence[float]) -> DataFrame:
    """keys, m (rows), q: the least value, sketched values at ``probabilities``, the largest."""
    asked = [min(max(p, 0.0), 1.0) for p in probabilities]
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("m"),
        F.concat(
            F.array(F.min("value")), F.percentile_approx("value", asked, ACCURACY), F.array(F.max("value"))
        ).alias("q"),
    )


def _brackets(rows: DataFrame, group: list[str], probabilities: Sequence[float]) -> DataFrame:
    """group, i, rank (from 0), weight, low, high, m: what encloses the rank below each probability."""
    asked = [p + sign * slack for p in probabilities for slack, _ in _SLACK for sign in (-1, 1)]
    found = _sketch(rows, group, asked)

    def bracket(i: int, p: float) -> Column:
        position = F.lit(float(p)) * (F.col("m") - 1)
        low, high = F.element_at("q", 1), F.element_at("q", -1)
        for k, (_, least) in reversed(list(enumerate(_SLACK))):
            at = 2 + 2 * (len(_SLACK) * i + k)
            wide = F.col("m") >= least
            low, high = F.when(wide, F.element_at("q", at)).otherwise(low), F.when(wide, F.element_at("q", at + 1)).otherwise(high)
        return F.struct(
            F.lit(i).alias("i"),
            F.floor(position).cast("bigint").alias("rank"),
            (position - F.floor(position)).alias("weight"),
            low.alias("low"),
            high.alias("high"),
            F.col("m"),
        )

    return found.select(*group, F.inline(F.array(*[bracket(i, p) for i, p in enumerate(probabilities)])))


def _inside(rows: DataFrame, brackets: DataFrame, group: list[str], sent) -> DataFrame:
    """group, i, value of the rows up to a bracket's end; null for a value below it."""
    met = rows.join(sent(brackets.select(*group, "i", "low", "high")), group).where(F.col("value") <= F.col("high"))
    return met.select(*group, "i", F.when(F.col("value") >= F.col("low"), F.col("value")).alias("value"))


def _narrowed(rows: DataFrame, brackets: DataFrame, group: list[str], sent) -> DataFrame:
    """Brackets of a few thousandths of the rows inside the given ones."""
    parts = 1000
    keys = [*group, "i"]
    near = _inside(rows, brackets, group, sent)
    below = near.groupBy(*keys).agg(F.count_if(F.col("value").isNull()).alias("below"))
    grid = _sketch(near.where(F.col("value").isNotNull()), keys, [k / parts for k in range(parts + 1)])
    step = F.col("inside") / F.lit(float(parts))
    # a step of the grid and three rows to either side: sketch and rounding are off by less
    first = F.greatest(F.floor((F.col("rank") - F.col("below") - 3) / step) - 1, F.lit(-1))
    last = F.least(F.ceil((F.col("rank") - F.col("below") + 4) / step) + 1, F.lit(parts + 1))
    held = brackets.drop("m").join(below, keys).join(grid.withColumnRenamed("m", "inside"), keys)
    low, high = F.element_at("q", (first + 2).cast("int")), F.element_at("q", (last + 2).cast("int"))
    # one that stands still is nearly all one value, which is counted as one row
    still = (low == F.col("low")) & (high == F.col("high"))
    size = F.when(still, F.lit(0)).otherwise(F.ceil((last - first + 1) * step))
    return held.select(*keys, "rank", "weight", low.alias("low"), high.alias("high"), size.cast("bigint").alias("m"))


def exact_quantiles(
    df: DataFrame, values: Sequence[str], probabilities: Sequence[float], by: Sequence[str] = ()
) -> DataFrame:
    """Linearly interpolated quantiles ``q0, q1, ...`` per group and value column.

    Nulls and not-a-numbers do not count; a column without other values has no row.
    """
    group = [*by, "column"]
    long = df.select(*by, *[F.col(c).cast("double").alias(c) for c in values]).unpivot(list(by), list(values), "column", "value")
    rows = long.where(F.col("value").isNotNull() & ~F.isnan("value"))
    for g in by:  # a null group is a group like any other, but equal to none in a join
        rows = rows.withColumn(g, F.struct(F.col(g).alias("v")))
    brackets = stored(_brackets(rows, group, probabilities), "quantile-brackets")
    size = brackets.agg(F.count(F.lit(1)).alias("n"), F.max("m").alias("m")).first()
    sent = F.broadcast if size["n"] <= SENT_GROUPS * max(1, len(probabilities)) else (lambda frame: frame)
    # a bracket's share of its rows, both ends off by the sketch's error
    share = F.when(F.col("m") >= _SLACK[0][1], F.lit(6 / ACCURACY)).otherwise(F.lit(1.0))
    brackets = brackets.withColumn("m", F.ceil(F.col("m") * share))
    while (brackets.agg(F.max("m")).first()[0] or 0) > BRACKET:
        brackets = stored(_narrowed(rows, brackets, group, sent), "quantile-brackets")

    keys = [*group, "i"]
    counts = stored(_inside(rows, brackets, group, sent).groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n")), "quantile-counts")
    in_order = Window.partitionBy(*keys).orderBy("value")  # the null of the rows below comes first
    upto = counts.withColumn("last", F.sum("n").over(in_order))
    placed = upto.withColumn("first", F.col("last") - F.col("n")).join(sent(brackets.select(*keys, "rank", "weight")), keys)

    def holds(rank: Column) -> Column:
        return (F.col("first") <= rank) & (rank < F.col("last"))

    at, after = holds(F.col("rank")), holds(F.col("rank") + 1) & (F.col("weight") > 0)
    part = F.when(at, F.col("value") * (1 - F.col("weight"))).otherwise(0.0) + F.when(after, F.col("value") * F.col("weight")).otherwise(0.0)
    out = placed.where(at | after).groupBy(*group).agg(
        *[F.sum(F.when(F.col("i") == i, part)).alias(f"q{i}") for i in range(len(probabilities))]
    )
    return out.select(*[F.col(g)["v"].alias(g) for g in by], "column", *[f"q{i}" for i in range(len(probabilities))])
