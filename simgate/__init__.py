"""Similarity-gate: reference-set verification, threshold calibration and evaluation on Spark."""

from simgate.operators.guards import GuardError
from simgate.operators.metrics import confusion, fixed_rates, group_table, summarize, sweep, sweep_grid
from simgate.operators.scoring import AGGREGATIONS, chosen, reference_set, score, score_all
from simgate.operators.splits import sample_per_group, three_way
from simgate.operators.thresholds import POLICIES, candidate_rates, pick, winner
from simgate.plans.calibrate import Settings, calibrate, classify, evaluate

__all__ = [
    "AGGREGATIONS", "GuardError", "POLICIES", "Settings", "calibrate", "candidate_rates", "chosen", "classify", "confusion", "evaluate", "fixed_rates",
    "group_table", "pick", "reference_set", "sample_per_group", "score", "score_all", "summarize", "sweep", "sweep_grid", "three_way", "winner",
]
