"""Hand-computed values for single operators."""

import math

import pytest
from pyspark.accumulators import AccumulatorParam
from pyspark.sql import functions as F

from simgate.functions import scalars, vectors
from simgate.operators import guards, inference, metrics, relations, scoring, splits, thresholds

NAN = float("nan")
SCORED = "kind string, ord long, name string, score double, best_match string, group string"


def scored(spark, pos, neg):
    rows = [("positive", i, f"p{i}", s, "r", None) for i, s in enumerate(pos)] + [("negative", i, f"n{i}", s, "r", g) for i, (s, g) in enumerate(neg)]
    return spark.createDataFrame(rows, SCORED)


def one(df):
    return df.first().asDict()


def test_normalize(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0] * 4,)], "v array<float>")
    got = [r[0] for r in df.select(vectors.l2_normalize(F.col("v"))).collect()]
    assert got[0] == pytest.approx([0.6, 0.8]) and got[1] == [0.0] * 4


def reference(spark, rows):
    return spark.createDataFrame([(i, n, v) for i, (n, v) in enumerate(rows)], "ord int, name string, embedding array<float>")


@pytest.mark.parametrize("block", [2000, 2])
def test_best_match_and_means(spark, monkeypatch, block):
    monkeypatch.setattr(scoring, "BLOCK", block)
    ref = reference(spark, [("x", [1.0, 0.0, 0.0]), ("y", [0.0, 1.0, 0.0]), ("z", [0.0, 0.0, 1.0]), ("y2", [0.0, 1.0, 0.0])])
    q = spark.createDataFrame([(1, [0.1, 0.9, 0.0]), (2, [0.0, 0.0, 0.0])], "name long, embedding array<float>")
    got = {r.name: r for r in scoring.score_all(q, ref).collect()}
    norm = math.sqrt(0.82)
    assert got[1].best_match == "y" and got[1].best_ord == 1
    assert got[1].score_max == pytest.approx(0.9 / norm, abs=1e-7)
    assert got[1].score_mean_top3 == pytest.approx((0.9 + 0.9 + 0.1) / 3 / norm, abs=1e-7)
    assert got[2].score_max == 0.0 and got[2].best_match == "x"  # a zero vector ties everywhere: the first


def test_small_reference_means_over_what_there_is(spark):
    ref = reference(spark, [("a", [1.0, 0.0]), ("b", [0.0, 1.0])])
    q = spark.createDataFrame([(1, [1.0, 0.0])], "name long, embedding array<float>")
    assert scoring.score_all(q, ref).first().score_mean_top3 == 0.5


def test_empty_reference_is_an_error(spark):
    with pytest.raises(guards.GuardError):
        scoring.reference_set(reference(spark, [("a", [1.0])]).where("false"))
    with pytest.raises(guards.GuardError):
        scoring.chosen(spark.range(1), "median")


def test_summary(spark):
    got = one(metrics.summarize(scored(spark, [0.0, 0.5, 1.0], [])))
    assert (got["n"], got["mean"], got["p50"], got["max"]) == (3, 0.5, 0.5, 1.0) and got["p95"] == pytest.approx(0.95)
    empty = one(metrics.summarize(scored(spark, [], [])))
    assert empty["n"] == 0 and empty["mean"] is None


def test_grid(spark):
    df = scored(spark, [0.83, 0.12], [])
    got = [r[0] for r in metrics.sweep_grid(df, 0.05).orderBy("cutoff").collect()]
    assert got[0] == 0.1 and got[-1] == 0.85 and got == metrics.grid(0.12, 0.83, 0.05)
    assert metrics.sweep_grid(df.where("false"), 0.05).count() == 0
    with pytest.raises(guards.GuardError):
        metrics.sweep_grid(df, 0)


def test_sweep_at_half(spark):
    df = scored(spark, [0.8, 0.4], [(0.6, "Persian"), (0.3, "Persian"), (0.5, "Abyssinian")])
    cut = spark.createDataFrame([(0.5,)], "cutoff double")
    got = one(metrics.sweep(df, cut, ["Persian"]))
    assert got["fpr_overall"] == pytest.approx(2 / 3) and (got["fpr_hard"], got["fpr_easy"], got["recall"]) == (0.5, 1.0, 0.5)
    assert one(metrics.sweep(df.where("group = 'Abyssinian' OR kind = 'positive'"), cut, ["Persian"]))["fpr_hard"] is None
    by = {r.group: r.fpr for r in metrics.group_sweep(df, cut).collect()}
    assert by == {"Persian": 0.5, "Abyssinian": 1.0}


def test_nan_and_null_groups(spark):
    df = scored(spark, [NAN, 0.9], [(NAN, "a"), (0.6, None), (0.1, "")])
    got = one(metrics.confusion(df, 0.5))
    assert got == {"tp": 1, "fn": 1, "fp": 1, "tn": 2}
    table = {r.group: (r.fpr, r.n) for r in metrics.group_table(df, 0.5).collect()}
    assert table == {"a": (0.0, 1), "(unknown)": (0.5, 2)}
    assert one(metrics.fixed_rates(df, 0.5, ["a"]))["fpr_easy"] == 0.5


def test_confusion_and_errors(spark):
    df = scored(spark, [0.9, 0.4], [(0.6, "g"), (0.2, "g"), (0.5, "h")])
    assert one(metrics.confusion(df, 0.5)) == {"tp": 1, "fn": 1, "fp": 2, "tn": 1}
    assert [r.score for r in metrics.errors(df, 0.5, "negative").collect()] == [0.6, 0.5]
    assert [r.score for r in metrics.errors(df, 0.5, "positive").collect()] == [0.4]
    assert [r.verdict for r in metrics.export(df, 0.5).collect()] == ["hit", "hit", "miss", "miss", "hit"]


def test_group_table_order(spark):
    df = scored(spark, [], [(0.9, "Persian"), (0.1, "Persian"), (0.9, "Abyssinian"), (0.1, "Birman"), (0.2, "Birman"), (0.3, "Birman"), (0.1, "Ragdoll")])
    got = [r.group for r in metrics.group_table(df, 0.5).orderBy(*metrics.group_table_order()).collect()]
    assert got == ["Abyssinian", "Persian", "Birman", "Ragdoll"]


def test_overlap(spark):
    got = one(metrics.overlap(scored(spark, [0.5, 0.9], [(0.6, "a"), (0.6, "b"), (0.1, "c")])))
    assert (got["lowest_positive"], got["highest_negative"], got["negatives_over"], got["positives_under"]) == ("p0", "n0", 2, 1)
    assert got["gap"] == pytest.approx(-0.1)


@pytest.mark.parametrize(
    ("policy", "target", "group", "cutoff"),
    [("target-fpr", 0.05, "hard", 0.8), ("target-fpr", 0.5, "hard", 0.55), ("target-fpr", 0.5, "overall", 0.55), ("youdens-j", 0, "hard", 0.55), ("equal-error", 0, "hard", 0.65)],
)
def test_policies(spark, policy, target, group, cutoff):
    df = scored(spark, [0.9, 0.6], [(0.5, "Persian"), (0.7, "Persian"), (0.3, "Abyssinian")])
    assert thresholds.pick(df, policy, ["Persian"], target, group).first().cutoff == pytest.approx(cutoff)


def test_policy_tie_and_candidates(spark):
    df = scored(spark, [0.9, 0.3], [(0.1, "a"), (0.7, "a")])
    assert thresholds.pick(df, "youdens-j", []).first().cutoff == pytest.approx(0.8)
    got = sorted(r.cutoff for r in thresholds.candidate_rates(scored(spark, [0.8], [(0.2, "a"), (0.5, "a")]), []).collect())
    assert got == pytest.approx([0.199, 0.35, 0.65, 0.801])
    with pytest.raises(guards.GuardError):
        thresholds.check_inputs(df, "target-fpr", ["missing"])
    with pytest.raises(guards.GuardError):
        thresholds.check_inputs(df.where("kind = 'positive'"), "youdens-j", [])
    with pytest.raises(guards.GuardError):
        thresholds.pick(df, "target-fpr", [], -0.1)


def test_winner(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "aggregation string, fpr_hard double, fpr_overall double, recall double")
    assert thresholds.winner(rows(("mean-top3", 0.048, 0.1, 0.9), ("max", 0.061, 0.1, 1.0))).first().aggregation == "mean-top3"
    assert thresholds.winner(rows(("mean-top3", 0.048, 0.1, 1.0), ("max", 0.048, 0.1, 0.9))).first().aggregation == "mean-top3"
    assert thresholds.winner(rows(("mean-top3", None, 0.1, 1.0), ("max", None, 0.1, 1.0))).first().aggregation == "max"


def test_split_invariants(spark):
    names = spark.createDataFrame([(f"p{i:02d}",) for i in range(35)], "name string")
    roles = lambda seed=1, ref=15, cal=10, flag=None: splits.positive_roles(names, seed, ref, cal, 10, flag)
    by = lambda df, role: [r.name for r in df.where(F.col("role") == role).orderBy("ord").collect()]
    base = roles()
    assert [len(by(base, r)) for r in ("reference", "calibration", "test")] == [15, 10, 10]
    assert len({n for r in ("reference", "calibration", "test") for n in by(base, r)}) == 35
    assert by(roles(ref=5, cal=3), "test") == by(base, "test") == by(roles(flag=F.col("name") > "p20"), "test")
    assert by(roles(seed=2), "test") != by(base, "test")
    preferred = by(roles(ref=5, flag=F.col("name").isin(by(base, "calibration"))), "reference")
    assert set(preferred) <= set(by(base, "calibration"))
    with pytest.raises(guards.GuardError, match="37"):
        splits.positive_roles(names, 1, 15, 10, 12)
    with pytest.raises(guards.GuardError):
        splits.positive_roles(names, 1, 0, 10, 10)


def test_stratified(spark):
    rows = [(f"a{i}", "a") for i in range(10)] + [(f"b{i}", "b") for i in range(10)] + [(f"t{i}", "Tiny") for i in range(3)] + [(f"h{i}", "half") for i in range(5)]
    df = splits.stratified(spark.createDataFrame(rows, "name string, group string"), 7, 0.3)
    got = {(r.group, r.role): r["count"] for r in df.groupBy("group", "role").count().collect()}
    assert got[("a", "test")] == got[("b", "test")] == 3 and got[("Tiny", "test")] == 1 and got[("half", "test")] == 2  # 1.5 goes to the even 2
    with pytest.raises(guards.GuardError):
        splits.stratified(df, 7, 1.5)
    sampled = splits.sample_per_group(spark.createDataFrame(rows, "name string, group string"), 3, 7)
    assert {r.group: r["count"] for r in sampled.groupBy("group").count().collect()} == {"a": 3, "b": 3, "Tiny": 3, "half": 3}
    assert splits.sample_per_group(sampled, 0, 7) is sampled


def test_disjoint(spark):
    rows = spark.createDataFrame([("d", "r", "x"), ("d", "s", "x"), ("e", "r", "x")], "dataset string, role string, name string")
    with pytest.raises(guards.GuardError, match="d/x"):
        guards.disjoint(rows)
    assert splits.overlaps(rows).count() == 1


def test_geometry_and_scalars(spark):
    box = lambda b, m: one(spark.range(1).select(scalars.crop_box(*map(F.lit, b), m, F.lit(100), F.lit(100)).alias("b")).select("b.*"))
    size = lambda b: (b["right"] - b["left"], b["bottom"] - b["top"])
    assert size(box((40, 40, 60, 60), 0)) == (20, 20) and size(box((40, 40, 60, 60), 0.1)) == (24, 24) and size(box((0, 0, 20, 20), 0.5)) == (30, 30)
    got = spark.createDataFrame([(" YES ", "a_b_3.jpg", ""), (None, "plain", None)], "f string, n string, g string")
    rows = got.select(scalars.is_yes(F.col("f")), scalars.group_of_filename(F.col("n")), scalars.group_or_unknown(F.col("g"))).collect()
    assert [tuple(r) for r in rows] == [(True, "a_b", "(unknown)"), (False, "plain", "(unknown)")]
    assert scalars.crop_slug(True, 0.1) == "detect-m0.1" and scalars.crop_slug(False, 0.1) == "no-detect"


def test_relations(spark):
    left = spark.createDataFrame([("a",), ("b",)], "name string")
    right = spark.createDataFrame([("a", "old", 1), ("a", "new", 2), ("b", "x", 3)], "name string, v string, ord int")
    assert {r.name: r.v for r in relations.with_attributes(left, right, "name", "ord").collect()} == {"a": "new", "b": "x"}
    with pytest.raises(guards.GuardError, match="1 names are missing"):
        relations.with_attributes(left, right.where("name = 'a'"), "name", "ord")
    images = spark.createDataFrame([("i", [(0.9, 1)]), ("j", [])], "name string, detections array<struct<confidence:double,x1:int>>")
    got = relations.detection_rows(images).orderBy("name").collect()
    assert [(r.name, r.n_detections, r.detection_index) for r in got] == [("i", 1, 1), ("j", 0, None)]
    crops = spark.createDataFrame([(1, 0.2), (1, 0.9), (2, 0.1)], "image_id long, score double")
    hits = {r.image_id: (r.status, r.crops) for r in relations.any_hit(spark.range(1, 4).withColumnRenamed("id", "image_id"), crops, 0.8).collect()}
    assert hits == {1: ("hit", 2), 2: ("miss", 1), 3: ("no_crop", 0)}


def test_inference_batches_and_status(spark):
    assert [len(b) for b in inference.filled(range(5), 2, lambda _: 1)] == [2, 2, 1] and list(inference.filled([], 2, len)) == []
    assert list(inference.filled([5, 0, 0, 5, 0, 9, 9], 2, lambda x: x, most=15)) == [[5, 0, 0, 5], [0, 9, 9]] and list(inference.filled([9, 9, 1], 9, lambda x: x, most=15)) == [[9, 9], [1]]
    df = spark.createDataFrame([(1, bytearray(b"a")), (2, bytearray(b"")), (3, bytearray(b"a"))], "k long, c binary").coalesce(1)
    got = {r.k: r for r in inference.embed(df, "c", inference.stub_embedder, batch=2).collect()}
    assert got[1].embedding == got[3].embedding and got[2].status == "corrupt"

    def detector():
        box = lambda c: {"confidence": c, "x1": 0, "y1": 0, "x2": 2, "y2": 2, "area_fraction": 0.1}
        return lambda contents: [None if not c else [box(0.1), box(0.5), box(0.9)] if bytes(c) == b"a" else [] for c in contents]

    found = {r.k: r for r in inference.detect(df.union(spark.createDataFrame([(4, bytearray(b"z"))], df.schema)), "c", detector).collect()}
    assert [d.confidence for d in found[1].detections] == [0.9, 0.5] and found[2].status == "corrupt" and found[4].status == "no_detection"


def test_notes_fan_out_and_zip_is_strict(spark):
    found = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "image string, k int")
    notes = spark.createDataFrame([("a", "x"), ("a", "y")], "image string, notes string")
    assert sorted((r.image, r.k, r.notes or "") for r in relations.with_notes(found, notes, "image").collect()) == [("a", 1, "x"), ("a", 1, "y"), ("a", 2, "x"), ("a", 2, "y"), ("b", 1, "")]
    rows = spark.createDataFrame([("a", [1, 2], ["p", "q"])], "image string, d array<int>, c array<string>")
    assert [tuple(r) for r in relations.zipped(rows, "image", "d", "c").collect()] == [("a", 1, 1, "p"), ("a", 2, 2, "q")]
    with pytest.raises(Exception, match="differ in length"):
        relations.zipped(rows.withColumn("c", F.array(F.lit("p"))), "image", "d", "c").collect()


def test_models_that_raise_and_crops(spark):
    def load():
        def model(items):
            if any(bytes(x) == b"bad" for x in items):
                raise ValueError("cannot decode")
            return [[{"confidence": c, "x1": 40, "y1": 40, "x2": 60, "y2": 60, "area_fraction": 0.1} for c in (0.5, 0.9, 0.1)] if bytes(x) != b"none" else [] for x in items]

        return model

    images = spark.createDataFrame([("a", b"img"), ("b", b"bad"), ("c", b"none")], "name string, content binary")
    cut = lambda raw, box: raw + str(box).encode()
    got = sorted(((r.name, r.status, r.detection_index, r.confidence, bytes(r.crop) if r.crop else None) for r in inference.detect_and_crop(images, "content", load, cut).collect()), key=str)
    box = b"img(38, 38, 62, 62)"
    assert got == [("a", "ok", 1, 0.9, box), ("a", "ok", 2, 0.5, box), ("b", "corrupt", None, None, None), ("c", "no_detection", None, None, None)]
    top = {r.name: r for r in inference.embedded_crops(images, "content", load, cut, inference.stub_embedder).collect()}
    assert len(top["a"].embedding) == 8 and [top[n].status for n in "abc"] == ["ok", "corrupt", "no_detection"]
    with pytest.raises(guards.GuardError):
        inference.detect_and_crop(images, "content", load, cut, margin=-1)
    flat = lambda: lambda items: [[{"confidence": 0.9, "x1": 5, "y1": 0, "x2": 5, "y2": 4, "area_fraction": 0.0}] for _ in items]
    assert {r.status for r in inference.detect_and_crop(images, "content", flat, cut).collect()} == {"corrupt"}


def test_one_pass_over_pictures(spark):
    """Batches fill across Arrow batches, one bad picture spoils itself alone, and no content crosses the network."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        contents = [b"p%02d" % i for i in range(20)] + [b"", b"boom", b"flat", b"odd"]
        images = spark.createDataFrame([(i, f"g{i % 3}", c) for i, c in enumerate(contents)], "id int, group string, content binary").coalesce(1)
        sizes = spark.sparkContext.accumulator([0], _Lists())

        def load():
            def model(items):
                sizes.add([len(items)])
                box = lambda c: {"confidence": 0.9, "x1": 1, "y1": 0, "x2": 1 if c == b"flat" else 5, "y2": 4, "area_fraction": 0.5}
                return [None if not c else [] if c.endswith(b"7") else [box(c)] for c in items]

            return model

        def cut(raw, edges):
            if raw == b"boom":
                raise OSError("cannot cut")
            return raw

        def embedder():
            def model(crops):
                if b"odd" in crops:
                    raise ValueError("cannot embed")
                return [[float(len(c)), float(c[-1])] for c in crops]

            return model

        found = inference.embedded_crops(images, "content", load, cut, embedder, batch=8)
        plan = found._jdf.queryExecution().executedPlan().toString()
        got = found.collect()
        assert plan.count("MapInArrow") == 1 and "Join" not in plan and not [line for line in plan.splitlines() if "Exchange" in line and "content" in line]
        assert [r.id for r in got] == list(range(24)) and [r.group for r in got] == [f"g{i % 3}" for i in range(24)]
        assert sizes.value[1:] == [8, 8, 8]
        assert {r.id: r.status for r in got if r.status != "ok"} == {7: "no_detection", 17: "no_detection", 20: "corrupt", 21: "corrupt", 22: "corrupt", 23: "corrupt"}
        assert list(got[3].embedding) == [3.0, float(b"3"[0])] and got[20].embedding is None
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


class _Lists(AccumulatorParam):
    def zero(self, value):
        return []

    def addInPlace(self, a, b):  # noqa: N802
        return a + b


def test_detection_text(spark):
    kind = "name string, detections array<struct<confidence:double,area_fraction:double>>, crops array<string>"
    rows = spark.createDataFrame([("a.jpg", [], []), ("b.jpg", [(0.91, 0.25)], ["b.png"]), ("c.jpg", [(0.79, 0.95), (0.5, 0.1)], ["c.png", None])], kind)
    got = {r.name: r.text for r in relations.detection_text(rows).collect()}
    assert got == {
        "a.jpg": "a.jpg: NO CAT DETECTED", "b.jpg": "b.jpg: 1 cat, confidence 0.91, 25% of frame -> b.png",
        "c.jpg": "c.jpg: MULTIPLE CATS (2)\n  confidence 0.79, 95% of frame, LOW CONFIDENCE, NEARLY FULL FRAME -> c.png\n  confidence 0.50, 10% of frame, LOW CONFIDENCE (crop not saved)",
    }


def test_places_by_ranges(spark):
    from simgate.operators import ranges

    rows = spark.range(1000).selectExpr("id", "id % 7 AS g", "id * 37 % 1000 AS v")
    got = ranges.running(rows, {"v": F.col("v")}, {"place": F.lit(1), "total": F.col("v")}, following="v").collect()
    assert all((r.place, r.total, r.next_v) == (r.v + 1, r.v * (r.v + 1) // 2, r.v + 1 if r.v < 999 else None) for r in got) and len(got) == 1000
    within = ranges.placed_within(rows, "g", {"v": F.col("v")}, "place").collect()
    for g in range(7):
        own = sorted((r.v, r.place) for r in within if r.g == g)
        assert [p for _, p in own] == list(range(1, len(own) + 1)) and {r.n for r in within if r.g == g} == {len(own)}


def test_scores_find_their_place_in_the_grid(spark):
    cutoffs = [round(k * 0.1, 10) for k in range(-3, 8)]
    grid = spark.createDataFrame([(c,) for c in cutoffs], "cutoff double")
    scores = [-9.0, -0.3, -0.25, 0.0, 0.1, 0.30000000000000004, 0.3, 0.69, 0.7, 5.0, NAN]
    got = metrics.bucketed(scored(spark, scores, [(s, "g") for s in scores[:4]]), grid, ["g"]).collect()
    want = {}
    for kind, own in (("positive", scores), ("negative", scores[:4])):
        for s in own:
            k = kind, sum(s >= c for c in cutoffs)
            want[k] = want.get(k, 0) + 1
    assert {(r.kind, r.reached): r.n for r in got} == want and {r.is_hard for r in got if r.kind == "negative"} == {True}
    one_cut = metrics.bucketed(scored(spark, scores, []), grid.limit(1), []).collect()
    assert {r.reached: r.n for r in one_cut} == {0: 2, 1: 9}
    assert metrics.sweep(scored(spark, scores, []), grid.where("false"), []).collect() == []


def test_pages_behind_keys(spark):
    rows = [(s, i) for i, s in enumerate([None, "a", "b", "a", None, "", "c", "b", "a", "c", None])]
    df = spark.createDataFrame(rows, "s string, i int").repartition(3)
    want = [(r.s, r.i) for r in df.orderBy("s", "i").collect()]
    got, key = [], None
    while True:
        page = metrics.page_after(df, key, 3, "s", "i")
        assert "TakeOrderedAndProject" in page._jdf.queryExecution().executedPlan().toString()
        own = [(r.s, r.i) for r in page.collect()]
        if not own:
            break
        got += own
        key = metrics.last_key(page, "s", "i")
        assert key == own[-1]
    assert got == want and metrics.last_key(page, "s", "i") is None
    assert [(r.s, r.i) for r in metrics.page(df, 1, 3, "s", "i").collect()] == want[3:6]


def test_external_hard_groups(spark):
    from simgate.plans import calibrate

    df = scored(spark, [0.9], [(0.8, "Norwegian Forest Cat"), (0.6, "Bengal")])
    got = one(metrics.fixed_rates(df, 0.7, list(calibrate.EXTERNAL_HARD_GROUPS)))
    assert (got["fpr_overall"], got["fpr_hard"], got["fpr_easy"]) == (0.5, 1.0, 0.0) and len(calibrate.EXTERNAL_HARD_GROUPS) == 14
