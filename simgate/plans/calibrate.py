"""Whole runs: choose and freeze a threshold, grade a frozen one, classify new images."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from simgate.functions.scalars import passes
from simgate.operators import guards, metrics, relations, scoring, splits, thresholds
from simgate.operators.metrics import NEGATIVE, POSITIVE
from simgate.sources import artifact as artifacts
from simgate.sources import split_store
from simgate.sources.shared import kept

#: Defaults of the split and of the target policy.
REFERENCE, CALIBRATION, TEST, TEST_FRACTION, TARGET_FPR, SWEEP_STEP = 15, 10, 10, 0.3, 0.05, 0.05
#: Look-alike groups of the first negatives, and of the external ones (whose names have spaces).
HARD_GROUPS = ("Birman", "Maine_Coon", "Persian", "Ragdoll")
EXTERNAL_HARD_GROUPS = (
    "Balinese", "Birman", "Domestic Long Hair", "Himalayan", "Maine Coon", "Nebelung", "Norwegian Forest Cat", "Persian", "Ragamuffin", "Ragdoll", "Siberian",
    "Somali", "Turkish Angora", "Turkish Van",
)
#: What reference and calibration members may be preferred by: a flag of the positives' attributes.
PREFERENCES = ("head", "tail", "both")


@dataclass
class Settings:
    seed: int = 20240601
    reference: int = REFERENCE
    calibration: int = CALIBRATION
    test: int = TEST
    test_fraction: float = TEST_FRACTION
    aggregation: str = "max"
    policy: str | None = None
    target_fpr: float = TARGET_FPR
    target_group: str = "hard"
    step: float = SWEEP_STEP
    prefer: str | None = None
    hard: list[str] = field(default_factory=lambda: list(HARD_GROUPS))


def preferred(prefer: str | None):
    """The condition on head_visible and tail_visible that a preference stands for."""
    if prefer is None:
        return None
    guards.one_of(prefer, PREFERENCES, "the preference")
    head, tail = F.col("head_visible"), F.col("tail_visible")
    return {"head": head, "tail": tail, "both": head & tail}[prefer]


def make_split(positives: DataFrame, negatives: DataFrame, settings: Settings) -> DataFrame:
    """``positives`` has head_visible and tail_visible where the settings prefer some."""
    return splits.three_way(positives, negatives, settings.seed, settings.reference, settings.calibration, settings.test, settings.test_fraction, preferred(settings.prefer))


def score_roles(roles: DataFrame, positives: DataFrame, negatives: DataFrame, which: str, reference: DataFrame | None = None) -> DataFrame:
    """Scores (both aggregations, in one pass, written once) of the members of roles: ``setup`` (calibration and setup) or ``test``.

    ``positives`` and ``negatives`` are caches (name, embedding[, group][, row]); a vector belongs to a name in its group
    and dataset, the last row of a repeated one. ``reference`` replaces the split's own.
    """
    cache = relations.keyed(positives.drop("group"), POSITIVE).unionByName(relations.keyed(negatives, NEGATIVE))
    if reference is None:  # a missing vector is null, which the reference set refuses
        reference = relations.vectors_or_none(roles.where("role = 'reference'").select("ord", *relations.KEY), cache).drop("found")
    wanted = roles.where(F.col("role") == "test" if which == "test" else F.col("role").isin("calibration", "setup"))
    queries = relations.vectors_or_none(wanted.select("role", "ord", *relations.KEY), cache)
    scored = scoring.score_all(queries.select(F.col("dataset").alias("kind"), "role", "ord", "name", "group", "found", "embedding"), reference)
    seen = Observation()  # whether all were there is told by the write itself
    out = kept(scored.observe(seen, F.count_if(~F.col("found")).alias("missing")), "scored")
    if seen.get["missing"]:
        first = out.where("NOT found").orderBy("kind", "group", "name").limit(5).collect()
        raise guards.GuardError(f"{seen.get['missing']} names are missing from the caches: " + ", ".join("/".join(x for x in (r["kind"], r["group"], r["name"]) if x) for r in first))
    return out.drop("found")


def calibrate(spark: SparkSession, positives: DataFrame, negatives: DataFrame, identity: dict, settings: Settings, split_dir: str | None = None, artifact_dir: str | None = None, poses: DataFrame | None = None, replay: bool = False, records: DataFrame | None = None) -> dict:
    """Draw (or replay) the split, score the setup roles, choose a threshold and freeze it.

    Returns the frames and the choice; the test roles are never scored here. ``positives`` and
    ``negatives`` are caches (name, embedding[, group]); ``records`` has the flags that a preference needs.
    """
    guards.one_of(settings.aggregation, scoring.AGGREGATIONS, "the aggregation")
    guards.require(artifact_dir is None or settings.policy is not None, "an artifact needs a policy")
    guards.require(not replay or split_dir is not None, "a split to replay must be named")
    if replay:
        roles, header = split_store.read_split(spark, split_dir)
        guards.same_variant(header["identity"], identity, "the split and the caches")
    else:
        named = positives.select("name")
        if settings.prefer is not None:
            guards.require(records is not None, "a preference needs the positives' attributes")
            guards.all_present(named, records, "name", "the attribute table")
            named = named.join(records.select("name", "head_visible", "tail_visible"), "name", "left")
        roles = make_split(named, negatives.select("name", "group"), settings)
        if split_dir is not None:
            roles = split_store.write_split(roles, split_dir, identity, vars(settings))
        else:
            roles = kept(roles, "roles")
            guards.disjoint(roles)
    scored = score_roles(roles, positives, negatives, "setup")
    rows = scoring.chosen(scored, settings.aggregation)
    out = {"roles": roles, "scored": rows, "grid": metrics.sweep_grid(rows, settings.step)}
    buckets = kept(metrics.bucketed(rows, out["grid"], settings.hard), "buckets")  # counted once for both curves
    out |= {"sweep": metrics.curve(buckets, out["grid"]), "group_sweep": metrics.group_curves(buckets, out["grid"])}
    if settings.policy is None:
        return out
    heads = {}
    thresholds.check_inputs(rows, settings.policy, settings.hard, settings.target_group)  # of the rows, whatever their scores
    for aggregation in scoring.AGGREGATIONS:
        own = scoring.chosen(scored, aggregation)
        heads[aggregation] = thresholds.pick(own, settings.policy, settings.hard, settings.target_fpr, settings.target_group).first().asDict()
    frame = spark.createDataFrame([{"aggregation": a, **{k: h[k] for k in ("fpr_hard", "fpr_overall", "recall")}} for a, h in heads.items()], "aggregation string, fpr_hard double, fpr_overall double, recall double")
    out["choices"], out["choice"] = heads, heads[settings.aggregation]
    if artifact_dir is not None:
        best = thresholds.winner(frame).first()["aggregation"]
        chosen = roles.where("role = 'reference'").select("ord", *relations.KEY)
        reference = kept(relations.vectors_or_none(chosen, relations.keyed(positives.drop("group"), POSITIVE)).select("ord", "name", "embedding"), "reference")
        if poses is not None:
            guards.all_present(reference, poses, "name", "the attribute table")
            reference = reference.join(poses.select("name", "position", "view"), "name", "left")
        else:
            reference = reference.withColumns({"position": F.lit(""), "view": F.lit("")})
        own = scoring.chosen(scored, best)
        curve = out["sweep"] if best == settings.aggregation else metrics.sweep(own, metrics.sweep_grid(own, settings.step), settings.hard)
        provenance = {"policy": settings.policy, "target_fpr": settings.target_fpr, "target_group": settings.target_group, "seed": settings.seed, "hard_groups": settings.hard}
        out["artifact"] = artifacts.write_artifact(artifact_dir, reference, heads[best]["cutoff"], best, identity, heads[best], heads, curve, provenance)
    return out


def evaluate(spark: SparkSession, artifact_dir: str, split_dir: str, positives: DataFrame, negatives: DataFrame, identity: dict, external: DataFrame | None = None, single_group: str | None = None, hard: list[str] | None = None) -> dict:
    """Grade a frozen artifact on the test roles, or on all ``external`` negatives instead of the split's.

    ``hard``: the groups that count as hard; else those of the artifact, or for external negatives their own.

    Returns one-row frames (confusion, rates, drift), the group table and the error lists.
    """
    document, reference = artifacts.read_artifact(spark, artifact_dir)
    roles, header = split_store.read_split(spark, split_dir)
    guards.same_variant(document["embedding"], identity, "the artifact and the caches")
    guards.same_variant(header["identity"], identity, "the split and the caches")
    guards.same_rows(roles.where("role = 'reference'").select("name"), reference.select("name"), "the reference sets of split and artifact")
    if external is not None:
        guards.not_empty(external, "the external cache")
        listed = relations.keyed(external, NEGATIVE).groupBy(*relations.KEY).agg(F.max("ord").alias("ord"))
        place = F.col("ord") if "row" in external.columns else F.xxhash64("group", "name")  # tells members apart
        members = listed.select("dataset", F.lit("test").alias("role"), place.alias("ord"), "name", F.nullif(F.col("group"), F.lit("")).alias("group"))
        roles, negatives = roles.where(F.col("dataset") == POSITIVE).unionByName(members), external
    for kind in (POSITIVE, NEGATIVE):
        guards.not_empty(roles.where((F.col("dataset") == kind) & (F.col("role") == "test")), f"the test role of {kind}s")
    if hard is None:
        hard = document["provenance"]["hard_groups"] if external is None else list(EXTERNAL_HARD_GROUPS)
    threshold = document["threshold"]
    rows = scoring.chosen(score_roles(roles, positives, negatives, "test", reference), document["aggregation"])
    rates = metrics.fixed_rates(rows, threshold, hard)
    before = spark.createDataFrame([{k: document["metrics"][k] for k in ("fpr_overall", "fpr_hard", "recall")}], "fpr_overall double, fpr_hard double, recall double")
    out = {
        "document": document, "roles": roles, "parameters": header["parameters"], "scored": rows, "confusion": metrics.confusion(rows, threshold), "rates": rates, "groups": metrics.group_table(rows, threshold).orderBy(*metrics.group_table_order()),
        "false_positives": metrics.errors(rows, threshold, NEGATIVE), "false_negatives": metrics.errors(rows, threshold, POSITIVE), "export": metrics.export(rows, threshold),
    }
    if external is None:
        out["drift"] = metrics.drift(before, rates.drop("fpr_easy"))
    if single_group is not None:
        out["single_group"] = metrics.single_group_rate(rows, single_group, threshold)
    return out


def classify(crops: DataFrame, images: DataFrame, artifact_dir: str, threshold: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Crops (image_id, crop_index, embedding) judged one by one, and a row for each image.

    An image is a hit if any of its crops is. A given threshold is clamped to the frozen curve's range.
    """
    spark = crops.sparkSession
    document, reference = artifacts.read_artifact(spark, artifact_dir)
    width = crops.agg(F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
    guards.require(width[0] is None or set(width) == {document["reference"]["dim"]}, f"embeddings are {width[0]} to {width[1]} wide, the reference set {document['reference']['dim']}")
    cutoffs = [p["cutoff"] for p in document["curve"]]
    at = document["threshold"] if threshold is None else min(max(threshold, min(cutoffs)), max(cutoffs))
    rows = scoring.chosen(scoring.score_all(crops, reference), document["aggregation"])
    poses = reference.select("name", "position", "view")
    judged = relations.pose_of(rows.withColumns({"hit": passes(F.col("score"), at), "margin": F.col("score") - F.lit(at)}), poses)
    return judged, relations.any_hit(images, judged, at)

