"""Candidate cutoffs and the policies that choose one.

Distinct scores are counted per class first; rates at all candidates then come from one running sum
over them, by ranges, so no score is compared with every cutoff and no task sees all scores.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simgate.functions.scalars import is_hard
from simgate.operators import guards
from simgate.operators.metrics import NEGATIVE, POSITIVE, rounded
from simgate.operators.ranges import running

PAD = 1e-3
POLICIES = ("target-fpr", "youdens-j", "equal-error")
GROUPS = ("hard", "overall")


def score_counts(scored: DataFrame, hard: list[str]) -> DataFrame:
    """score with the numbers of positives, negatives and hard negatives that have it."""
    pos, neg = F.col("kind") == POSITIVE, F.col("kind") == NEGATIVE
    rows = scored.where(~F.isnan("score") & F.col("score").isNotNull())
    return rows.groupBy("score").agg(F.count_if(pos).alias("p"), F.count_if(neg).alias("n"), F.count_if(neg & is_hard(F.col("group"), hard)).alias("h"))


def candidate_rates(scored: DataFrame, hard: list[str]) -> DataFrame:
    """cutoff, recall, fpr_overall and fpr_hard at every candidate cutoff.

    Candidates are the midpoints of neighbouring distinct scores and two beyond the ends.
    """
    below = running(score_counts(scored, hard), {"score": F.col("score")}, {f"{c}_upto": F.col(c) for c in "pnh"}, following="score")
    totals = below.agg(*(F.sum(c).alias(f"{c}_all") for c in "pnh"), F.min("score").alias("low"))
    inner = below.select(F.coalesce((F.col("score") + F.col("next_score")) / 2, F.col("score") + PAD).alias("cutoff"), *(f"{c}_upto" for c in "pnh"))
    lowest = totals.where("low IS NOT NULL").select((F.col("low") - PAD).alias("cutoff"), *(F.lit(0).cast("long").alias(f"{c}_upto") for c in "pnh"))
    share = lambda c: F.try_divide(F.col(f"{c}_all") - F.col(f"{c}_upto"), F.col(f"{c}_all"))
    return inner.union(lowest).crossJoin(F.broadcast(totals)).select("cutoff", share("p").alias("recall"), share("n").alias("fpr_overall"), share("h").alias("fpr_hard"))


def pick(scored: DataFrame, policy: str, hard: list[str], target_fpr: float = 0.05, target_group: str = "hard") -> DataFrame:
    """One row: cutoff, recall, fpr_overall, fpr_hard. Equal choices go to the higher cutoff, but the target's to the lowest."""
    guards.one_of(policy, POLICIES, "the policy")
    guards.one_of(target_group, GROUPS, "the target's group")
    rates = candidate_rates(scored, hard)
    if policy == "target-fpr":
        guards.require(target_fpr >= 0, f"the target rate must not be negative: {target_fpr}")
        rows = rates.where(F.col(f"fpr_{target_group}") <= target_fpr).orderBy("cutoff")
    elif policy == "youdens-j":
        rows = rates.orderBy(F.desc(F.round(F.col("recall") - F.col("fpr_overall"), 12)), F.desc("cutoff"))
    else:
        rows = rates.orderBy(F.round(F.abs(F.col("fpr_overall") - (1 - F.col("recall"))), 12), F.desc("cutoff"))
    return rows.limit(1).select(*(rounded(F.col(c)).alias(c) for c in ("cutoff", "recall", "fpr_overall", "fpr_hard")))


def check_inputs(scored: DataFrame, policy: str, hard: list[str], target_group: str = "hard") -> None:
    """Both classes must have scores; a hard target needs hard negatives."""
    neg = F.col("kind") == NEGATIVE
    p, n, h = scored.agg(F.count_if(F.col("kind") == POSITIVE), F.count_if(neg), F.count_if(neg & is_hard(F.col("group"), hard))).first()
    guards.require(p > 0 and n > 0, f"a threshold needs positives and negatives: {p} and {n}")
    guards.require(policy != "target-fpr" or target_group != "hard" or h > 0, "no negatives in hard groups for a target on them")


def winner(headline: DataFrame) -> DataFrame:
    """The aggregation with the least hard rate (overall where null), then the most recall, then ``max``."""
    order = [F.coalesce("fpr_hard", "fpr_overall"), F.desc("recall"), F.when(F.col("aggregation") == "max", 0).otherwise(1)]
    return headline.orderBy(*order).limit(1)
