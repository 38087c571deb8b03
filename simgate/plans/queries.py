"""The registered queries: each applies an operator to whole test tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simgate.functions import scalars, vectors
from simgate.operators import inference, metrics, relations, scoring, splits, thresholds
from simgate.operators.metrics import NEGATIVE, POSITIVE, rounded
from simgate.plans import inputs
from simgate.plans.inputs import HARD, SEED, STEP, TEST, TEST_FRACTION, THRESHOLD
from simgate.sources.shared import kept

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _shown(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.withColumn("score", rounded(F.col("score"))).select(*columns)


@query
def l2_normalize(spark: SparkSession, d: str) -> DataFrame:
    rows = inputs.read(spark, d, "embeddings").select("vec_id", F.posexplode(vectors.l2_normalize(F.col("embedding"))).alias("i", "x"))
    return rows.select("vec_id", (F.col("i") + 1).cast("long").alias("i"), F.round("x", 9).alias("x"))


@query
def cosine_scores(spark: SparkSession, d: str) -> DataFrame:
    own = inputs.positive_roles(spark, d).select("name", "role")
    members = own.where("role <> 'reference'").union(inputs.negative_roles(spark, d).select("name", "role"))
    cache = inputs.read(spark, d, "embeddings").select(F.col("vec_id").alias("name"), "embedding")
    return scoring.pairs(members.join(cache, "name"), cache.join(F.broadcast(own.where("role = 'reference'")), "name"), "name").withColumn("sim", rounded(F.col("sim")))


@query
def best_match_max(spark: SparkSession, d: str) -> DataFrame:
    return _shown(scoring.chosen(inputs.scored(spark, d), "max"), "name", "kind", "role", "score", "best_match")


@query
def best_match_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Every query twice, under one name, against references in blocks of seven: both rows stay."""
    members, vectors = inputs.to_score(spark, d)
    both = scoring.score_all(members.union(members), vectors, block=7)
    return _shown(scoring.chosen(both, "mean-top3"), "name", "kind", "role", "score", "best_match")


@query
def best_match_mean_top3(spark: SparkSession, d: str) -> DataFrame:
    return _shown(scoring.chosen(inputs.scored(spark, d), "mean-top3"), "name", "kind", "role", "score", "best_match")


@query
def verdict_margin(spark: SparkSession, d: str) -> DataFrame:
    s = inputs.scored(spark, d)
    return s.select("name", scalars.passes(F.col("score_max"), THRESHOLD).alias("hit"), rounded(F.col("score_max") - THRESHOLD).alias("margin"))


@query
def split_test_first(spark: SparkSession, d: str) -> DataFrame:
    return splits.test_first(inputs.positives(spark, d).select("name"), SEED, TEST).withColumn("shuffle_rank", F.col("shuffle_rank").cast("long"))


@query
def split_stratified(spark: SparkSession, d: str) -> DataFrame:
    return splits.stratified(inputs.negatives(spark, d), SEED, TEST_FRACTION).withColumn("ord", F.col("ord").cast("long"))


@query
def split_prefer(spark: SparkSession, d: str) -> DataFrame:
    ranked = splits.test_first(inputs.positives(spark, d).select("name"), SEED, TEST)
    return splits.prefer(ranked, F.col("name") % 2 == 0).select("name", F.col("setup_rank").cast("long").alias("setup_rank"))


@query
def split_roles(spark: SparkSession, d: str) -> DataFrame:
    return splits.role_summary(inputs.roles(spark, d))


@query
def group_counts(spark: SparkSession, d: str) -> DataFrame:
    return splits.group_counts(inputs.negatives(spark, d))


@query
def sample_per_group(spark: SparkSession, d: str) -> DataFrame:
    return splits.sample_per_group(inputs.negatives(spark, d), 7, SEED).select("name", "group")


@query
def role_overlap(spark: SparkSession, d: str) -> DataFrame:
    roles = inputs.roles(spark, d).select("dataset", "role", "name")
    extra = roles.where("name % 10 = 0").withColumn("role", F.lit("extra"))
    return splits.overlaps(roles.union(extra)).withColumn("name", F.col("name").cast("string"))


@query
def score_summary(spark: SparkSession, d: str) -> DataFrame:
    return metrics.summarize(scoring.chosen(inputs.scored(spark, d), "max"), "kind", "role")


@query
def hard_easy_stats(spark: SparkSession, d: str) -> DataFrame:
    return metrics.hard_easy_stats(kept(inputs.setup(spark, d), "scored"), HARD)


@query
def group_stats(spark: SparkSession, d: str) -> DataFrame:
    return metrics.group_stats(inputs.setup(spark, d))


@query
def overlap_report(spark: SparkSession, d: str) -> DataFrame:
    return metrics.overlap(kept(inputs.setup(spark, d), "scored"))


@query
def sweep_grid(spark: SparkSession, d: str) -> DataFrame:
    return metrics.sweep_grid(inputs.setup(spark, d), STEP)


@query
def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    rows = kept(inputs.setup(spark, d), "scored")
    return metrics.sweep(rows, metrics.sweep_grid(rows, STEP), HARD)


@query
def group_sweep(spark: SparkSession, d: str) -> DataFrame:
    rows = kept(inputs.setup(spark, d), "scored")
    return metrics.group_sweep(rows, metrics.sweep_grid(rows, STEP))


@query
def group_fpr_table(spark: SparkSession, d: str) -> DataFrame:
    return metrics.group_table(inputs.setup(spark, d), THRESHOLD)


@query
def confusion(spark: SparkSession, d: str) -> DataFrame:
    return metrics.confusion(inputs.held_out(spark, d), THRESHOLD)


@query
def fixed_rates(spark: SparkSession, d: str) -> DataFrame:
    return metrics.fixed_rates(inputs.held_out(spark, d), THRESHOLD, HARD)


@query
def single_group_fpr(spark: SparkSession, d: str) -> DataFrame:
    return metrics.single_group_rate(inputs.held_out(spark, d), "1", THRESHOLD)


@query
def risk_negatives(spark: SparkSession, d: str) -> DataFrame:
    return _shown(metrics.risks(inputs.setup(spark, d), NEGATIVE), "name", "score", "best_match", "group")


@query
def risk_positives(spark: SparkSession, d: str) -> DataFrame:
    return _shown(metrics.risks(inputs.setup(spark, d), POSITIVE), "name", "score", "best_match")


@query
def false_positives(spark: SparkSession, d: str) -> DataFrame:
    return _shown(metrics.errors(inputs.held_out(spark, d), THRESHOLD, NEGATIVE), "name", "score", "best_match", "group")


@query
def false_negatives(spark: SparkSession, d: str) -> DataFrame:
    return _shown(metrics.errors(inputs.held_out(spark, d), THRESHOLD, POSITIVE), "name", "score", "best_match")


@query
def scores_export(spark: SparkSession, d: str) -> DataFrame:
    rows = metrics.export(inputs.held_out(spark, d), THRESHOLD)
    return _shown(metrics.placed(rows), "place", "kind", "name", "score", "verdict", "best_match", "group")


@query
def candidate_cutoffs(spark: SparkSession, d: str) -> DataFrame:
    rates = thresholds.candidate_rates(inputs.setup(spark, d), HARD)
    return rates.select(*(rounded(F.col(c)).alias(c) for c in rates.columns))


def _pick(policy: str, group: str = "hard") -> Query:
    return lambda spark, d: thresholds.pick(inputs.setup(spark, d), policy, HARD, 0.05, group)


QUERIES |= {
    "pick_target_fpr_hard": _pick("target-fpr"), "pick_target_fpr_overall": _pick("target-fpr", "overall"),
    "pick_youdens_j": _pick("youdens-j"), "pick_equal_error": _pick("equal-error"),
}


@query
def aggregation_winner(spark: SparkSession, d: str) -> DataFrame:
    rows = kept(inputs.scored(spark, d).where("role IN ('calibration', 'setup')"), "scored")
    heads = [metrics.fixed_rates(scoring.chosen(rows, a), THRESHOLD, HARD).withColumn("aggregation", F.lit(a)) for a in scoring.AGGREGATIONS]
    return thresholds.winner(reduce(DataFrame.union, heads)).select("aggregation", "fpr_overall", "fpr_hard", "fpr_easy", "recall")


@query
def drift_table(spark: SparkSession, d: str) -> DataFrame:
    rows = kept(scoring.chosen(inputs.scored(spark, d), "max"), "scored")
    return metrics.drift(*(metrics.fixed_rates(rows.where(where), THRESHOLD, HARD) for where in ("role <> 'test'", "role = 'test'")))


@query
def external_confusion(spark: SparkSession, d: str) -> DataFrame:
    rows = scoring.chosen(inputs.scored(spark, d), "max")
    return metrics.confusion(rows.where(f"kind = '{NEGATIVE}' OR role = 'test'"), THRESHOLD)


@query
def same_experiment(spark: SparkSession, d: str) -> DataFrame:
    """Whether the reference set is that of another draw: the same seed, another seed, and one altered name."""
    draw = lambda seed: splits.positive_roles(inputs.positives(spark, d).select("name"), seed, inputs.REFERENCE, inputs.CALIBRATION, TEST).where("role = 'reference'").select("name")
    first = kept(draw(SEED), "reference")
    altered = first.withColumn("name", F.when(F.col("name") == first.agg(F.min("name")).first()[0], -1).otherwise(F.col("name")))
    rows = []
    for case, other in (("same seed", draw(SEED)), ("other seed", draw(SEED + 1)), ("altered", altered)):
        differ = first.exceptAll(other).union(other.exceptAll(first))
        rows.append(differ.agg(F.lit(case).alias("case"), (F.count(F.lit(1)) == 0).alias("same"), F.count(F.lit(1)).alias("differ")))
    return reduce(DataFrame.union, rows)


#: Groups of the external negatives that count as hard, apart from those of the split.
EXTERNAL_HARD = ["4", "5"]


@query
def external_rates(spark: SparkSession, d: str) -> DataFrame:
    """All negatives as external ones, with hard groups of their own."""
    rows = scoring.chosen(inputs.scored(spark, d), "max")
    return metrics.fixed_rates(rows.where(f"kind = '{NEGATIVE}' OR role = 'test'"), THRESHOLD, EXTERNAL_HARD)


@query
def keyed_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of names that stand in several groups and several times in one: each group has its own, of repeats the last row."""
    cache = inputs.read(spark, d, "embeddings").select((F.col("vec_id") % 20).alias("name"), F.col("label").alias("group"), F.col("vec_id").alias("row"), "embedding")
    cache = relations.keyed(cache, NEGATIVE)
    found = relations.vectors_of(cache.select(*relations.KEY).distinct(), cache, "the cache")
    return found.select("group", "name", *(rounded(F.col("embedding")[i].cast("double")).alias(f"x{i}") for i in range(2)))


@query
def detections_with_notes(spark: SparkSession, d: str) -> DataFrame:
    """Pages as detections beside the turns of the conversation of their number as notes: an output for each turn, one without where there is none."""
    notes = inputs.read(spark, d, "conversations").select(F.col("conv_id").alias("image"), F.col("text").alias("notes"))
    found = inputs.read(spark, d, "pages").select(F.col("page_id").alias("image"), "url")
    return relations.with_notes(found, notes, "image").select("image", "url", "notes")


@query
def detections_with_crops(spark: SparkSession, d: str) -> DataFrame:
    """Detections of each image (lines of an order, by quantity) and its crops (the lines' parts, by number), zipped by place."""
    lines = inputs.read(spark, d, "lineitem")
    found = lines.groupBy(F.col("l_orderkey").alias("image")).agg(F.array_sort(F.collect_list(F.struct("l_quantity", "l_linenumber"))).alias("detections"))
    crops = lines.groupBy(F.col("l_orderkey").alias("image")).agg(F.array_sort(F.collect_list("l_partkey")).alias("crops"))
    both = relations.zipped(found.join(crops, "image"), "image", "detections", "crops")
    return both.select("image", "place", F.col("left.l_quantity").cast("double").alias("quantity"), F.col("right").alias("crop"))


@query
def catalog_misses(spark: SparkSession, d: str) -> DataFrame:
    return relations.misses(inputs.read(spark, d, "documents").select("doc_id", "source"), inputs.read(spark, d, "labels"), "doc_id")


@query
def attribute_left_join(spark: SparkSession, d: str) -> DataFrame:
    attributes = inputs.read(spark, d, "labels").withColumn("ord", F.col("doc_id"))
    return relations.with_attributes(inputs.read(spark, d, "documents").select("doc_id", "source"), attributes, "doc_id", "ord", total=False)


@query
def pose_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Poses come from the whole table of parts; a reference without a part of its number has none."""
    poses = inputs.read(spark, d, "part").select((F.col("p_partkey") * 2).alias("name"), F.col("p_brand").alias("position"), F.col("p_type").alias("view"))
    return relations.pose_of(inputs.scored(spark, d).select("name", "best_match"), poses).select("name", "best_match", "position", "view")


@query
def page_of_misses(spark: SparkSession, d: str) -> DataFrame:
    return metrics.page(catalog_misses(spark, d), 1, 24, "source", "doc_id")


@query
def page_after_key(spark: SparkSession, d: str) -> DataFrame:
    """The third page, each page found behind the last key of the one before."""
    rows, key = kept(catalog_misses(spark, d), "misses"), None
    for _ in range(2):
        key = metrics.last_key(metrics.page_after(rows, key, 24, "source", "doc_id"), "source", "doc_id")
    return metrics.page_after(rows, key, 24, "source", "doc_id")


@query
def crop_geometry(spark: SparkSession, d: str) -> DataFrame:
    part = inputs.read(spark, d, "part").selectExpr("p_partkey", "cast(p_partkey % 90 as int) x1", "cast(p_partkey % 70 as int) y1", "cast(p_partkey % 90 + p_size as int) x2", "cast(p_partkey % 70 + 2 * p_size as int) y2")
    x1, y1, x2, y2 = map(F.col, ("x1", "y1", "x2", "y2"))
    box = scalars.crop_box(x1, y1, x2, y2, 0.1, F.lit(120), F.lit(150))
    return part.select("p_partkey", box.alias("box"), rounded(scalars.area_fraction(x1, y1, x2, y2, F.lit(120), F.lit(150))).alias("area_fraction")).select("p_partkey", "box.*", "area_fraction")


@query
def detection_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Orders as detections in the images of their customers; customers without an order are images without any."""
    found = inputs.read(spark, d, "orders").selectExpr("o_custkey AS image", "(o_orderkey % 100) / 100D AS confidence", "(o_orderkey % 97) / 100D AS area_fraction")
    images = inputs.read(spark, d, "customer").selectExpr("c_custkey AS image")
    return relations.detection_rollup(found, images, "image")


@query
def detection_rank(spark: SparkSession, d: str) -> DataFrame:
    found = inputs.read(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_discount AS confidence")
    return relations.ranked_detections(found, "l_orderkey", "l_linenumber").select("l_orderkey", "l_linenumber", "detection_index")


@query
def filename_group(spark: SparkSession, d: str) -> DataFrame:
    return inputs.read(spark, d, "pages").select("page_id", scalars.group_of_filename(F.replace("url", F.lit("/"), F.lit("_"))).alias("grp"))


@query
def any_crop_hit(spark: SparkSession, d: str) -> DataFrame:
    """Every third query shows the image of its customer; customers that none shows have no crop."""
    crops = scoring.chosen(inputs.scored(spark, d), "max").withColumn("image_id", F.expr("name div 3"))
    return relations.any_hit(inputs.read(spark, d, "customer").select(F.col("c_custkey").alias("image_id")), crops, THRESHOLD).withColumn("best_score", rounded(F.col("best_score")))


@query
def variant_key(spark: SparkSession, d: str) -> DataFrame:
    part = inputs.read(spark, d, "part").selectExpr("p_brand", "p_size % 2 = 0 AS detect", "cast(p_size % 3 as double) * 0.1D AS margin")
    key = scalars.variant_key(F.col("p_brand"), F.col("detect"), F.col("margin"), F.lit(None).cast("double"))
    return part.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n")).select("key.model_id", "key.detect", "key.margin", "n")


@query
def status_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = attribute_left_join(spark, d)
    return relations.status_counts(rows.select(F.when(F.col("quality").isNull(), "missing").otherwise("ok").alias("status")))


@query
def embed_batches(spark: SparkSession, d: str) -> DataFrame:
    """Pages as images through the injected stub model: an empty page is corrupt."""
    pages = inputs.read(spark, d, "pages").select("page_id", F.col("html").cast("binary").alias("content"))
    return inference.embed(pages, "content", inference.stub_embedder).select("page_id", F.size("embedding").alias("dim"), "status")


@query
def picture_pass(spark: SparkSession, d: str) -> DataFrame:
    """Pages as pictures, detected, cut and embedded in one pass with stub models: what each page's surest crop measures."""
    pages = inputs.read(spark, d, "pages").select("page_id", F.col("html").cast("binary").alias("content"))
    found = inference.embedded_crops(pages, "content", inference.stub_detector, inference.stub_cut, inference.stub_measure)
    return found.select("page_id", "status", "detection_index", rounded(F.col("confidence")).alias("confidence"), "x1", "y1", "x2", "y2", F.col("embedding")[0].cast("double").alias("size"), F.col("embedding")[1].cast("double").alias("first"))
