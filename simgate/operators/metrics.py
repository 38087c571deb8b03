"""Score statistics, rates at cutoffs, per-group tables, confusion counts and error lists.

``scored`` has role (positive or negative, column ``kind``), name, score, best_match and group. A
rate over no rows is null. NaN scores never pass a cutoff. Percentiles come from counts of distinct
scores, numbered by ranges, so that no group's scores meet in one buffer.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from simgate.functions.scalars import group_or_unknown, is_hard, passes
from simgate.operators import ranges
from simgate.operators.guards import require
from simgate.operators.ranges import running_within

POSITIVE, NEGATIVE = "positive", "negative"
#: Digits of figures; of means fewer, as sums of doubles differ in their last digits with order.
ROUND, MEAN_ROUND = 12, 9
RISKS = 10


def rounded(c: Column) -> Column:
    return F.round(c, ROUND)


def summarize(scored: DataFrame, *by: str) -> DataFrame:
    """n, mean, min, p50, p95, max of the scores by columns without nulls; percentiles are exact and interpolated."""
    counts = scored.where("score IS NOT NULL").groupBy(*by, "score").agg(F.count(F.lit(1)).alias("count"))
    both = running_within(counts, list(by), {"score": F.col("score")}, F.col("count"), "upto")
    end = F.col("upto")  # places of a score in its group: from end - count, to before end

    def percentile(p: float) -> Column:
        at = (F.max("n") - 1) * F.lit(p)
        value = {}
        for side, place in (("low", F.floor((F.col("n") - 1) * F.lit(p))), ("high", F.ceil((F.col("n") - 1) * F.lit(p)))):
            value[side] = F.max(F.when((end - F.col("count") <= place) & (place < end), F.col("score")))
        return rounded(value["low"] + (value["high"] - value["low"]) * (at - F.floor(at)))

    return both.groupBy(*by).agg(
        F.coalesce(F.sum("count"), F.lit(0)).alias("n"), F.round(F.try_divide(F.sum(F.col("score") * F.col("count")), F.sum("count")), MEAN_ROUND).alias("mean"),
        rounded(F.min("score")).alias("min"), percentile(0.5).alias("p50"), percentile(0.95).alias("p95"), rounded(F.max("score")).alias("max"),
    )


def rate(score: Column, cutoff: Column | float, where: Column | None = None) -> Column:
    """Share of the rows (that ``where`` holds for) at or above a cutoff; null over none."""
    hit = F.when(passes(score, cutoff), 1.0).otherwise(0.0)
    return F.avg(hit if where is None else F.when(where, hit))


def grid(low: float, high: float, step: float) -> list[float]:
    """Multiples of step from the one at or below ``low`` to the one at or above ``high``."""
    import math

    require(step > 0, f"the step must be positive, not {step}")
    return [round(k * step, 10) for k in range(math.floor(low / step), math.ceil(high / step) + 1)]


def sweep_grid(scored: DataFrame, step: float) -> DataFrame:
    """The grid over the observed scores, as a column; empty without scores."""
    require(step > 0, f"the step must be positive, not {step}")
    bounds = scored.agg(F.min("score").alias("low"), F.max("score").alias("high")).where("low IS NOT NULL")
    ks = F.sequence(F.floor(F.col("low") / F.lit(step)), F.ceil(F.col("high") / F.lit(step)))
    return bounds.select(F.explode(ks).alias("k")).select(F.round(F.col("k") * F.lit(step), 10).alias("cutoff"))


#: Halvings of a search in a grid: it may have two to this power cutoffs.
HALVINGS = 24


def reached(cutoffs: Column, score: Column) -> Column:
    """How many of the sorted cutoffs a score reaches, by halving the grid; NaN reaches none."""
    step = lambda at, half: F.when((at + half <= F.size(cutoffs)) & (F.get(cutoffs, at + half - 1) <= score), at + half).otherwise(at)
    halves = F.array(*(F.lit(1 << k) for k in reversed(range(HALVINGS))))
    found = F.aggregate(F.filter(halves, lambda h: h <= F.size(cutoffs)), F.lit(0), step)
    return F.when(F.isnan(score) | score.isNull(), 0).otherwise(found)


def bucketed(scored: DataFrame, cutoffs: DataFrame, hard: list[str]) -> DataFrame:
    """kind, is_hard, group, reached, n and the highest score of the scores that reach so many cutoffs: what all curves are made of, in one aggregation.

    The grid is packed into one broadcast row, so a score meets it once and no row is multiplied.
    """
    packed = cutoffs.agg(F.array_sort(F.collect_list("cutoff")).alias("cutoffs"))
    by = [F.col("kind"), is_hard(F.col("group"), hard).alias("is_hard"), group_or_unknown(F.col("group")).alias("group")]
    counted = scored.crossJoin(F.broadcast(packed)).groupBy(*by, reached(F.col("cutoffs"), F.col("score")).alias("reached"))
    return counted.agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("max_score"))


def _numbered(cutoffs: DataFrame) -> DataFrame:
    return cutoffs.withColumn("place", F.row_number().over(Window.orderBy("cutoff")))  # a row for each cutoff


def curve(buckets: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """cutoff, fpr_overall, fpr_hard, fpr_easy and recall at every cutoff, from ``bucketed``."""
    neg = F.col("kind") == NEGATIVE
    parts = {"positive": F.col("kind") == POSITIVE, "hard": neg & F.col("is_hard"), "easy": neg & ~F.col("is_hard")}
    sums = [F.coalesce(F.sum(F.when(where, F.col("n"))), F.lit(0)).alias(name) for name, where in parts.items()]
    each = buckets.groupBy(F.col("reached").alias("place")).agg(*sums)  # a row for each cutoff, and one for none
    totals = buckets.agg(*(s.alias(f"all_{n}") for s, n in zip(sums, parts, strict=True)))
    upto = Window.orderBy(F.desc("place")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    passed = _numbered(cutoffs).join(each, "place", "left").withColumns({n: F.sum(F.coalesce(n, F.lit(0))).over(upto) for n in parts})
    share = lambda *own: rounded(F.try_divide(sum(F.col(n) for n in own), sum(F.col(f"all_{n}") for n in own)))
    rates = {"fpr_overall": share("hard", "easy"), "fpr_hard": share("hard"), "fpr_easy": share("easy"), "recall": share("positive")}
    return passed.crossJoin(F.broadcast(totals)).select(rounded(F.col("cutoff")).alias("cutoff"), *(c.alias(n) for n, c in rates.items()))


def group_curves(buckets: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """group, cutoff, fpr, max_score of negatives, from ``bucketed``; groups are ordered by their highest score when shown."""
    each = buckets.where(F.col("kind") == NEGATIVE).groupBy("group", F.col("reached").alias("place")).agg(F.sum("n").alias("n"), F.max("max_score").alias("max_score"))
    groups = each.groupBy("group").agg(F.sum("n").alias("total"), F.max("max_score").alias("max_score"))
    rows = groups.crossJoin(F.broadcast(_numbered(cutoffs))).join(each.drop("max_score"), ["group", "place"], "left")  # as many as come out
    upto = Window.partitionBy("group").orderBy(F.desc("place")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fpr = F.sum(F.coalesce("n", F.lit(0))).over(upto) / F.col("total")
    return rows.select("group", rounded(F.col("cutoff")).alias("cutoff"), rounded(fpr).alias("fpr"), rounded(F.col("max_score")).alias("max_score"))


def sweep(scored: DataFrame, cutoffs: DataFrame, hard: list[str]) -> DataFrame:
    """cutoff, fpr_overall, fpr_hard, fpr_easy and recall at every cutoff."""
    return curve(bucketed(scored, cutoffs, hard), cutoffs)


def group_sweep(scored: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """group, cutoff, fpr, max_score of negatives."""
    return group_curves(bucketed(scored.where(F.col("kind") == NEGATIVE), cutoffs, []), cutoffs)


def group_table(scored: DataFrame, threshold: float | Column) -> DataFrame:
    """group, fpr and n of negatives; shown by descending fpr, then n, then name."""
    neg = scored.where(F.col("kind") == NEGATIVE)
    return neg.groupBy(group_or_unknown(F.col("group")).alias("group")).agg(rounded(rate(F.col("score"), threshold)).alias("fpr"), F.count(F.lit(1)).alias("n"))


def group_table_order() -> list[Column]:
    return [F.desc("fpr"), F.desc("n"), F.asc("group")]


def fixed_rates(scored: DataFrame, threshold: float, hard: list[str]) -> DataFrame:
    """The rates at one threshold, in one pass."""
    neg, hard_ = F.col("kind") == NEGATIVE, is_hard(F.col("group"), hard)
    columns = {"fpr_overall": neg, "fpr_hard": neg & hard_, "fpr_easy": neg & ~hard_, "recall": F.col("kind") == POSITIVE}
    return scored.agg(*(rounded(rate(F.col("score"), threshold, where)).alias(name) for name, where in columns.items()))


def single_group_rate(scored: DataFrame, group: str, threshold: float) -> DataFrame:
    """fpr and n of one group; fpr is null if it has no rows."""
    own = (F.col("kind") == NEGATIVE) & (F.col("group") == group)
    return scored.agg(rounded(rate(F.col("score"), threshold, own)).alias("fpr"), F.count_if(own).alias("n"))


def confusion(scored: DataFrame, threshold: float) -> DataFrame:
    """tp, fn, fp, tn; what does not pass (NaN too) is counted as not passed."""
    hit = passes(F.col("score"), threshold)
    pos, neg = F.col("kind") == POSITIVE, F.col("kind") == NEGATIVE
    got = scored.agg(F.count_if(pos & hit).alias("tp"), F.count_if(pos).alias("p"), F.count_if(neg & hit).alias("fp"), F.count_if(neg).alias("q"))
    return got.select("tp", (F.col("p") - F.col("tp")).alias("fn"), "fp", (F.col("q") - F.col("fp")).alias("tn"))


def hard_easy_stats(scored: DataFrame, hard: list[str]) -> DataFrame:
    """mean, p95, max and number of groups (null counts as one) of hard and easy negatives."""
    neg = scored.where(F.col("kind") == NEGATIVE).withColumn("is_hard", is_hard(F.col("group"), hard))
    groups = F.countDistinct("group") + F.max(F.when(F.col("group").isNull(), 1).otherwise(0))
    return summarize(neg, "is_hard").join(neg.groupBy("is_hard").agg(groups.cast("long").alias("groups")), "is_hard")


def group_stats(scored: DataFrame) -> DataFrame:
    """Statistics of each group of negatives; shown by descending max."""
    neg = scored.where(F.col("kind") == NEGATIVE)
    return summarize(neg.withColumn("group", group_or_unknown(F.col("group"))), "group")


def overlap(scored: DataFrame) -> DataFrame:
    """Lowest positive, highest negative, their gap, and how many cross over; the first by ord among equal scores."""
    first = lambda kind, best: F.min_by(F.struct("name", "score"), F.struct((F.col("score") if best == "low" else -F.col("score")), "ord"))
    pos, neg = scored.where(F.col("kind") == POSITIVE), scored.where(F.col("kind") == NEGATIVE)
    ends = pos.agg(first("p", "low").alias("low")).crossJoin(neg.agg(first("n", "high").alias("high")))
    both = scored.crossJoin(F.broadcast(ends))
    over = F.count_if((F.col("kind") == NEGATIVE) & (F.col("score") >= F.col("low.score")))
    under = F.count_if((F.col("kind") == POSITIVE) & (F.col("score") <= F.col("high.score")))
    got = both.groupBy("low", "high").agg(over.alias("negatives_over"), under.alias("positives_under"))
    return got.select(
        F.col("low.name").alias("lowest_positive"), rounded(F.col("low.score")).alias("lowest_score"), F.col("high.name").alias("highest_negative"),
        rounded(F.col("high.score")).alias("highest_score"), rounded(F.col("low.score") - F.col("high.score")).alias("gap"), "negatives_over", "positives_under",
    )


def risks(scored: DataFrame, kind: str, n: int = RISKS) -> DataFrame:
    """The highest negatives or the lowest positives."""
    order = F.desc("score") if kind == NEGATIVE else F.asc("score")
    return scored.where(F.col("kind") == kind).orderBy(order, "ord").limit(n)


def errors(scored: DataFrame, threshold: float, kind: str) -> DataFrame:
    """All false positives by falling score, or all false negatives by rising score."""
    hit = passes(F.col("score"), threshold)
    rows = scored.where(F.col("kind") == kind).where(hit if kind == NEGATIVE else ~hit & ~F.isnan("score"))
    return rows.orderBy(F.desc("score") if kind == NEGATIVE else F.asc("score"), "ord")


def page(rows: DataFrame, number: int, size: int, *order: Column | str) -> DataFrame:
    """One page (from 0) of ordered rows."""
    return rows.orderBy(*order).offset(number * size).limit(size)


def _after(order: list[str], last: tuple) -> Column:
    """Whether a row comes behind the key ``last`` in rising order of the columns, nulls first."""
    behind, same = F.lit(False), F.lit(True)
    for name, value in zip(order, last, strict=True):
        c = F.col(name)
        behind = behind | (same & (c.isNotNull() if value is None else F.coalesce(c > F.lit(value), F.lit(False))))
        same = same & c.eqNullSafe(F.lit(value))
    return behind


def page_after(rows: DataFrame, last: tuple | None, size: int, *order: str) -> DataFrame:
    """The ``size`` rows behind the key of a page's last row (None: the first page), in rising order of columns that tell rows apart.

    Whatever the page, a task keeps ``size`` rows of those behind the key; nothing before it is sorted.
    """
    require(size > 0, f"a page needs rows, not {size}")
    found = rows if last is None else rows.where(_after(list(order), last))
    return found.orderBy(*order).limit(size)


def last_key(page_: DataFrame, *order: str) -> tuple | None:
    """The key of a page's last row, None for an empty page."""
    row = page_.agg(F.max(F.struct(*order)).alias("key")).first()["key"]
    return None if row is None else tuple(row)


def drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """metric, calibration, test and their difference, from two one-row frames of the same columns."""
    def tall(df: DataFrame, name: str) -> DataFrame:
        parts = [df.select(F.lit(c).alias("metric"), F.col(c).cast("double").alias(name)) for c in df.columns]
        return reduce(DataFrame.union, parts)

    both = tall(before, "calibration").join(tall(after, "test"), "metric")
    return both.withColumn("change", rounded(F.col("test") - F.col("calibration")))


def export(scored: DataFrame, threshold: float | None = None) -> DataFrame:
    """Negatives by falling score, then positives by rising score, with their place; a verdict where asked."""
    rank = F.when(F.col("kind") == NEGATIVE, 0).otherwise(1)
    signed = F.when(F.col("kind") == NEGATIVE, -F.col("score")).otherwise(F.col("score"))
    out = scored.withColumns({"role_rank": rank, "signed": signed})
    if threshold is not None:
        out = out.withColumn("verdict", F.when(passes(F.col("score"), threshold), "hit").otherwise("miss"))
    return out.orderBy("role_rank", "signed", "ord").drop("role_rank", "signed")


def placed(exported: DataFrame) -> DataFrame:
    """Number the rows of an export from 1, by ranges."""
    rank = F.when(F.col("kind") == NEGATIVE, 0).otherwise(1)
    signed = F.when(F.col("kind") == NEGATIVE, -F.col("score")).otherwise(F.col("score"))
    return ranges.placed(exported, {"rank": rank, "signed": signed, "ord": F.col("ord")}, "place")
