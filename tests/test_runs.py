"""Stores, guards against tampering, and whole runs on small caches."""

import glob
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from simgate.operators import guards
from simgate.plans import calibrate as runs
from simgate.plans import build, cli, report
from simgate.sources import artifact, cache, files, split_store
from simgate.streaming.scores import score_stream

IDENTITY = {"model_id": "m/one", "detect": True, "margin": 0.1, "min_confidence": 0.25}


def vector(seed: int, near: bool) -> list[float]:
    v = [((seed * 37 + k * 11) % 17) / 17 - 0.5 for k in range(8)]
    return [x * 0.3 + (1.0 if near and k == 0 else 0.0) for k, x in enumerate(v)]


def caches(spark, root):
    def rows(n, near, group):
        return [(i, f"{'p' if near else 'n'}{i:02d}", True, 0.9, 0, 0, 9, 9, 0.5, group(i), vector(i + 100 * near, near)) for i in range(n)]

    pos = spark.createDataFrame(rows(35, True, lambda i: None), cache.EMBEDDINGS)
    neg = spark.createDataFrame(rows(40, False, lambda i: ["Persian", "Bengal"][i % 2]), cache.EMBEDDINGS)
    for name, df in (("pos", pos), ("neg", neg)):
        cache.write_cache(df, f"{root}/{name}", IDENTITY["model_id"], True, 0.1, 0.25)
    return f"{root}/pos", f"{root}/neg"


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("run"))
    pos, neg = caches(spark, root)
    code = cli.main(["calibrate", "--positives", pos, "--negatives", neg, "--split", f"{root}/split", "--artifact", f"{root}/artifact", "--policy", "target-fpr", "--hard", "Persian", "--html", f"{root}/c.html", "--scores-out", f"{root}/scores"], spark)
    assert code == 0
    return root


def test_calibrate_and_evaluate(spark, stored, capsys):
    document, reference = artifact.read_artifact(spark, f"{stored}/artifact")
    assert document["aggregation"] in ("max", "mean-top3") and reference.count() == 15 and document["metrics"]["recall"] == 1.0
    assert "<table>" in open(f"{stored}/c.html").read() and glob.glob(f"{stored}/scores/*.csv")
    args = ["evaluate", "--positives", f"{stored}/pos", "--negatives", f"{stored}/neg", "--split", f"{stored}/split", "--artifact", f"{stored}/artifact"]
    assert cli.main(args, spark) == 0
    out = capsys.readouterr().out
    assert "Confusion" in out and "Drift" in out
    assert cli.main([*args, "--external", "--single-group", "Persian"], spark) == 0
    out = capsys.readouterr().out
    assert "Single group" in out and "Drift" not in out


def test_replay_keeps_the_split(spark, stored):
    pos, identity = cache.read_cache(spark, f"{stored}/pos")
    neg, _ = cache.read_cache(spark, f"{stored}/neg")
    pos, neg = (d.withColumn("name", F.col("source_filename")) for d in (pos, neg))
    run = runs.calibrate(spark, pos, neg, identity, runs.Settings(seed=999, hard=["Persian"]), f"{stored}/split", replay=True)
    before, _ = split_store.read_split(spark, f"{stored}/split")
    guards.same_rows(run["roles"], before, "splits")
    assert cli.main(["calibrate", "--positives", f"{stored}/pos", "--negatives", f"{stored}/neg", "--split", f"{stored}/split", "--replay", "--seed", "0"], spark) == 2


def test_classify(spark, stored):
    crops = spark.createDataFrame([(1, 0, vector(101, True)), (1, 1, [-1.0] + [0.0] * 7), (2, 0, [-1.0] + [0.0] * 7)], "image_id long, crop_index int, embedding array<float>")
    judged, images = runs.classify(crops, spark.range(1, 4).withColumnRenamed("id", "image_id"), f"{stored}/artifact")
    assert {r.image_id: r.status for r in images.collect()} == {1: "hit", 2: "miss", 3: "no_crop"}
    assert judged.where("hit AND margin >= 0").count() == 1
    with pytest.raises(guards.GuardError, match="wide"):
        runs.classify(crops.withColumn("embedding", F.slice("embedding", 1, 4)), images, f"{stored}/artifact")


def _rewrite(folder, change):
    (path,) = glob.glob(f"{folder}/part-*")
    document = json.loads(open(path).read())
    change(document)
    open(path, "w").write(json.dumps(document))
    for crc in glob.glob(f"{folder}/.*.crc"):
        import os

        os.remove(crc)


@pytest.mark.parametrize(("key", "value"), [("format_version", 1), ("comparison", ">")])
def test_tampered_artifact(spark, stored, tmp_path, key, value):
    import shutil

    shutil.copytree(f"{stored}/artifact", tmp_path / "a")
    _rewrite(tmp_path / "a/document", lambda d: d.__setitem__(key, value))
    with pytest.raises(guards.GuardError):
        artifact.read_artifact(spark, str(tmp_path / "a"))


def test_changed_reference_vectors(spark, stored, tmp_path):
    import shutil

    shutil.copytree(f"{stored}/artifact", tmp_path / "a")
    rows = spark.read.parquet(f"{stored}/artifact/reference")
    rows.withColumn("embedding", F.transform("embedding", lambda x: (x + 1).cast("float"))).write.mode("overwrite").parquet(str(tmp_path / "a/reference"))
    with pytest.raises(guards.GuardError, match="changed"):
        artifact.read_artifact(spark, str(tmp_path / "a"))


def test_tampered_split_and_cache(spark, stored, tmp_path):
    import shutil

    shutil.copytree(f"{stored}/split", tmp_path / "s")
    _rewrite(tmp_path / "s/header", lambda d: d["groups"]["test"].__setitem__("Persian", 99))
    with pytest.raises(guards.GuardError, match="group counts"):
        split_store.read_split(spark, str(tmp_path / "s"))
    shutil.copytree(f"{stored}/pos", tmp_path / "c")
    _rewrite(tmp_path / "c/identity", lambda d: d.__setitem__("row_count", 3))
    with pytest.raises(guards.GuardError, match="35 rows"):
        cache.read_cache(spark, str(tmp_path / "c"))
    with pytest.raises(guards.GuardError, match="different settings"):
        cache.read_cache(spark, f"{stored}/pos", IDENTITY | {"margin": 0.2})
    guards.same_variant(IDENTITY | {"detect": False}, IDENTITY | {"detect": False, "margin": 0.9}, "caches without a detector")


def test_files(spark, tmp_path):
    (tmp_path / "list.txt").write_text("# head\nMaine_Coon_1 1 1 6\n\nbeagle_2 5 2 1\nBirman_10 2 1 3\n")
    got = [tuple(r) for r in files.annotations(spark, str(tmp_path / "list.txt")).orderBy("group").collect()]
    assert got == [("Birman", "Birman_10.jpg"), ("Maine_Coon", "Maine_Coon_1.jpg")]
    (tmp_path / "bad.txt").write_text("a 1 1\n")
    with pytest.raises(guards.GuardError):
        files.annotations(spark, str(tmp_path / "bad.txt"))
    (tmp_path / "map.csv").write_text("number,new_filename,original_filename,position,location,view,head_visible,tail_visible,notes\n1,a.jpg,o.jpg,sit,,front,yes,no,\"one, two\"\n")
    row = files.attribute_table(spark, str(tmp_path / "map.csv")).first()
    assert row.notes == "one, two" and row.location == ""
    record = files.positive_records(spark.createDataFrame([("a.jpg",)], "source_filename string"), files.attribute_table(spark, str(tmp_path / "map.csv"))).first()
    assert record.head_visible and not record.tail_visible
    folder = tmp_path / "img" / "Maine Coon"
    folder.mkdir(parents=True)
    for n in ("x.JPG", "y.jpg", "z.txt"):
        (folder / n).write_bytes(b"1")
    assert {r.source_filename for r in files.image_folder(spark, str(folder)).collect()} == {"x.JPG", "y.jpg"}
    assert {(r.group, r.source_filename) for r in files.grouped_images(spark, str(tmp_path / "img")).collect()} == {("Maine Coon", "y.jpg")}
    with pytest.raises(guards.GuardError):
        files.negative_records(spark.range(1))


def test_report_formats():
    assert report.shown(float("nan")) == "-" and report.shown(0.12345) == "0.123" and report.percent(0.125) == "12.5%"
    rows = [{"name": f"n{i}<", "score": 0.5, "best_match": "r", "group": "g", "kind": "negative", "picture": f"g h/n{i}<"} for i in range(25)]
    out = report.pairs(rows, report.Folders("img", "ref"))
    assert out.count("<li><p>") == 20 and out.count("<figure>") == 40 and "+5 more not shown" in out and "n0&lt;" in out
    assert 'src="img/g h/n0&lt;" alt="n0&lt;"' in out and 'src="ref/r" alt="r"' in out  # the picture lies deep, its label is the name
    assert report.source_of("/data/img", "a/b.jpg", "/data/out/r.html") == "../img/a/b.jpg" and report.source_of("s3://x/img", "b.jpg", "/r.html") == "s3://x/img/b.jpg"
    assert report.pairs(rows[:1], report.Folders("img", "ref", "r.html")).count("+") == 0
    page = report.as_html("t", [("Errors", rows, ""), ("None", [], "")])
    assert "<img" not in page and "<th>picture</th>" not in page and "<h2>None</h2><p>none</p>" in page


def test_stream(spark, tmp_path):
    ref = spark.createDataFrame([(0, "a", [1.0, 0.0])], "ord int, name string, embedding array<float>")
    spark.createDataFrame([(1, [1.0, 0.1]), (2, [0.0, 1.0])], "name long, embedding array<float>").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("name long, embedding array<float>").parquet(str(tmp_path / "in"))
    q = score_stream(stream, ref, 0.5).writeStream.format("memory").queryName("scores").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.name: r.hit for r in spark.table("scores").collect()} == {1: True, 2: False}


def box(confidence, area=0.1, x1=40):
    return {"confidence": confidence, "x1": x1, "y1": 40, "x2": 60, "y2": 60, "area_fraction": area}


def load_detector():
    found = {b"none": [], b"one": [box(0.9)], b"two": [box(0.5), box(0.95)], b"low": [box(0.3)], b"full": [box(0.99, 0.97)]}
    return lambda items: [found.get(bytes(x)) for x in items]


def cut_box(raw, edges):
    return raw + b"@%d" % edges[0]


def load_embedder():
    return lambda items: [[float(len(x)), float(x[0])] for x in items]


HERE = "tests.test_runs"


def test_build_caches(spark, tmp_path, capsys):
    for group, names in (("Ragdoll", ("one", "two", "bad")), ("Maine Coon", ("one", "none", "low"))):
        (tmp_path / "img" / group).mkdir(parents=True)
        for n in names:
            (tmp_path / "img" / group / f"{n}.jpg").write_bytes(n.encode())
    models = ["--detector", f"{HERE}:load_detector", "--cut", f"{HERE}:cut_box", "--embedder", f"{HERE}:load_embedder", "--model", "m/one"]
    args = ["build", "--source", "groups", "--images", str(tmp_path / "img"), "--out", str(tmp_path / "out"), *models]
    assert cli.main([*args, "--catalog", str(tmp_path / "catalog")], spark) == 0
    assert sorted(spark.read.csv(str(tmp_path / "catalog"), header=True).toPandas().source_filename) == ["bad.jpg", "low.jpg", "none.jpg", "one.jpg", "one.jpg", "two.jpg"]
    rows, identity = cache.read_cache(spark, f"{tmp_path}/out/m--one/detect-m0.1")
    got = [(r.row, r.group, r.source_filename, r.confidence, r.detect_used, list(r.embedding)) for r in rows.orderBy("row").collect()]
    assert got == [
        (0, "Maine Coon", "low.jpg", 0.3, True, [6.0, 108.0]), (1, "Maine Coon", "one.jpg", 0.9, True, [6.0, 111.0]), (2, "Ragdoll", "one.jpg", 0.9, True, [6.0, 111.0]), (3, "Ragdoll", "two.jpg", 0.95, True, [6.0, 116.0]),
    ]
    assert (identity["margin"], identity["min_confidence"], identity["embedding_dim"]) == (0.1, 0.25, 2)
    out = capsys.readouterr().out
    assert "corrupt" in out and "no_detection" in out
    assert cli.main([*args, "--no-detect", "--per-group", "2", "--limit", "3", "--seed", "5"], spark) == 0
    whole, identity = cache.read_cache(spark, f"{tmp_path}/out/m--one/no-detect")
    groups = [r.group for r in whole.orderBy("row").collect()]
    assert groups == ["Maine Coon", "Maine Coon", "Ragdoll"] and identity["margin"] is None and whole.where("detect_used OR confidence IS NOT NULL").isEmpty()
    assert cli.main([*args[:3], "--images", str(tmp_path / "img"), "--out", "x"], spark) == 2
    with pytest.raises(guards.GuardError):
        build.sampled(files.image_folder(spark, str(tmp_path / "img" / "Ragdoll")), per_group=2)


def test_detect_run(spark, tmp_path, capsys):
    (tmp_path / "img").mkdir()
    (tmp_path / "crops").mkdir()
    for n in ("none", "one", "two", "low", "full", "bad"):
        (tmp_path / "img" / f"{n}.JPG").write_bytes(n.encode())
    (tmp_path / "crops" / "old_crop1.jpg").write_bytes(b"")
    (tmp_path / "crops" / "mine.txt").write_bytes(b"")
    args = ["detect", "--images", str(tmp_path / "img"), "--detector", f"{HERE}:load_detector", "--cut", f"{HERE}:cut_box", "--crops", str(tmp_path / "crops"), "--csv", str(tmp_path / "csv")]
    assert cli.main(args, spark) == 0
    out = capsys.readouterr().out
    assert {p.name for p in (tmp_path / "crops").iterdir()} == {"mine.txt", "one_crop1.jpg", "two_crop1.jpg", "low_crop1.jpg", "full_crop1.jpg"}
    assert (tmp_path / "crops" / "two_crop1.jpg").read_bytes() == b"two@38"
    assert "two.JPG: MULTIPLE CATS (2)" in out and "(crop not saved)" in out and "none.JPG: NO CAT DETECTED" in out
    summary = out[out.index("6 pictures") :].splitlines()
    assert summary == [
        "6 pictures, 4 crops saved", "  2 with exactly one detection at confidence 0.8 or more", "  2 without a detection: bad.JPG, none.JPG", "  1 with several detections: two.JPG (2)",
        "  1 with a best confidence below 0.8: low.JPG (0.300)", "  1 with a detection over 90% of the frame: full.JPG",
    ]
    lines = spark.read.csv(str(tmp_path / "csv"), header=True).orderBy("source_filename", "detection_index").collect()
    assert [(r.source_filename, r.image_width, r.n_detections, r.detection_index, r.crop_filename, r.confidence) for r in lines if r.source_filename[0] in "bt"] == [
        ("bad.JPG", None, "0", None, None, None), ("two.JPG", None, "2", "1", "two_crop1.jpg", "0.9500"), ("two.JPG", None, "2", "2", None, "0.5000"),
    ]
    assert cli.main([*args, "--all-crops"], spark) == 0 and (tmp_path / "crops" / "two_crop2.jpg").exists()


def test_npy_pair(spark, tmp_path):
    vectors = np.arange(2400, dtype=np.float64).reshape(1200, 2)
    np.save(tmp_path / "e.npy", vectors)
    head = "row,source_filename,detect_used,confidence,x1,y1,x2,y2,area_fraction\n"
    (tmp_path / "m.csv").write_text(head + "".join(f"{i},f{i}.jpg,true,0.5,1,2,3,4,0.1\n" for i in range(1200)))
    rows = cache.read_pair(spark, str(tmp_path / "m.csv"), cache.read_npy(spark, str(tmp_path / "e.npy")))
    assert rows.count() == 1200 and list(rows.where("row = 1100").first().embedding) == [2200.0, 2201.0]
    np.save(tmp_path / "short.npy", vectors[:7])
    with pytest.raises(guards.GuardError):
        cache.read_pair(spark, str(tmp_path / "m.csv"), cache.read_npy(spark, str(tmp_path / "short.npy")))


def test_names_are_keyed_by_group(spark, stored):
    """Equal names in two groups of an external set are two pictures; of a name that repeats in a group the last row counts."""
    pos, identity = cache.read_cache(spark, f"{stored}/pos")
    pos = pos.withColumn("name", F.col("source_filename"))
    near, far = vector(101, True), [-1.0] + [0.0] * 7
    rows = [(0, "1.jpg", "A", near), (1, "1.jpg", "B", far), (2, "2.jpg", "A", near), (3, "2.jpg", "A", far), (4, "3.jpg", None, near)]
    external = spark.createDataFrame(rows, "row long, name string, group string, embedding array<float>").repartition(3)
    run = runs.evaluate(spark, f"{stored}/artifact", f"{stored}/split", pos, pos, identity, external)
    got = sorted((r.name, r.group or "", r.score > 0) for r in run["scored"].where("kind = 'negative'").collect())
    assert got == [("1.jpg", "A", True), ("1.jpg", "B", False), ("2.jpg", "A", False), ("3.jpg", "", True)]
    assert run["export"].where("kind = 'negative'").count() == 4


def test_only_sampled_pictures_are_read(spark, tmp_path):
    names = ["a b.jpg", "c+d.JPG", "50%25.jpg", "q{1}[2]?*.jpeg", *(f"p{i:02d}.png" for i in range(20)), "notes.txt"]
    for n in names:
        (tmp_path / n).write_bytes(n.encode())
    images = files.image_folder(spark, str(tmp_path))
    assert sorted(r.source_filename for r in images.collect()) == sorted(names[:-1])
    chosen = build.sampled(images, limit=10)
    assert len(chosen.inputFiles()) == 10 and {r.source_filename: bytes(r.content).decode() for r in chosen.collect()} == {n: n for n in sorted(names[:-1])[:10]}
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan  # contents are not moved
    assert "content" not in images.select("source_filename")._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]
    for k in range(3):
        (tmp_path / "g" / f"G{k}").mkdir(parents=True)
        for i in range(5):
            (tmp_path / "g" / f"G{k}" / f"{i}.jpg").write_bytes(b"%d%d" % (k, i))
    some = build.sampled(files.grouped_images(spark, str(tmp_path / "g")), per_group=2, seed=3)
    assert len(some.inputFiles()) == 6 and sorted(bytes(r.content).decode()[0] for r in some.collect()) == list("001122")
    assert build.sampled(images.where("false"), limit=3).collect() == [] and files.attribute_table(spark, str(tmp_path / "none.csv")) is None


def test_fingerprint_is_the_tree_by_hand(spark, monkeypatch):
    import hashlib

    from simgate.sources import digests

    monkeypatch.setattr(digests, "FAN", 8)
    rows = [(i * 3 - 50, f"n{i}" if i % 7 else None, [float(i), -0.5, 1e-9] if i != 11 else None) for i in range(300)]
    frame = spark.createDataFrame(rows, "ord long, name string, embedding array<float>")
    level = {}
    for at, name, v in rows:
        title = (name or "").encode()
        level[at + 50] = hashlib.sha256(b"%d:%d:" % (at, len(title)) + title + (b"\0" if v is None else b"\1" + np.asarray(v, "<f4").tobytes())).hexdigest()
    for _ in range(4):  # 8 ** 4 numbers are more than there are
        nodes = {}
        for at in sorted(level):
            nodes.setdefault(at // 8, []).append(f"{at}={level[at]}")
        level = {k: hashlib.sha256(",".join(v).encode()).hexdigest() for k, v in nodes.items()}
    assert digests.fingerprint(frame.repartition(7)) == digests.fingerprint(frame.coalesce(1)) == level[0]
    assert digests.fingerprint(frame.where("ord <> 10")) != level[0] != digests.fingerprint(frame.withColumn("ord", F.col("ord") + 1))
    with pytest.raises(guards.GuardError, match="apart"):
        digests.fingerprint(frame.union(frame.limit(1)))
    assert digests.fingerprint(frame.where("false")) == hashlib.sha256(b"").hexdigest()


def test_writes_are_whole_or_not_at_all(spark, stored, tmp_path):
    import shutil

    from simgate.sources.shared import published

    rows, identity = cache.read_cache(spark, f"{stored}/pos")
    folder = str(tmp_path / "cache")
    cache.write_cache(rows, folder, "m/one", True, 0.1, 0.25)
    wrong = rows.withColumn("embedding", F.when(F.col("row") == 3, F.slice("embedding", 1, 2)).otherwise(F.col("embedding")))
    with pytest.raises(guards.GuardError, match="width"):
        cache.write_cache(wrong, folder, "m/two", True, 0.1, 0.25)
    kept, again = cache.read_cache(spark, folder)
    assert again == identity and kept.count() == 35 and [p.name for p in tmp_path.iterdir()] == ["cache"]
    cache.write_cache(rows.limit(4), folder, "m/two", False)
    assert cache.read_identity(spark, folder)["model_id"] == "m/two" and cache.read_cache(spark, folder)[0].count() == 4

    def torn(part):
        spark.range(3).write.parquet(f"{part}/reference")
        raise OSError("lost")

    shutil.copytree(f"{stored}/artifact", tmp_path / "a")
    with pytest.raises(OSError):
        published(spark, str(tmp_path / "a"), torn)
    assert artifact.read_artifact(spark, str(tmp_path / "a"))[1].count() == 15
    (part, *_) = glob.glob(f"{tmp_path}/a/reference/part-*")
    spark.read.parquet(f"{stored}/artifact/reference").where("ord < 9").coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "a/reference"))
    with pytest.raises(guards.GuardError, match="the artifact says 15"):
        artifact.read_artifact(spark, str(tmp_path / "a"))
    assert artifact.find_artifacts(spark, str(tmp_path)) == [f"file:{tmp_path}/a"] and artifact.find_artifacts(spark, str(tmp_path / "none")) == []


def test_named_artifacts_and_reports(spark, stored, tmp_path, capsys):
    """Without a name, an artifact and reports get one that tells what they were made with; an evaluation takes the last artifact."""
    common = ["--positives", f"{stored}/pos", "--negatives", f"{stored}/neg", "--split", f"{stored}/split", "--artifacts", str(tmp_path / "a"), "--reports", str(tmp_path / "r"), "--figures", str(tmp_path / "img"), "--nested-figures"]
    assert cli.main(["evaluate", *common], spark) == 2 and "calibrate first" in capsys.readouterr().err
    assert cli.main(["calibrate", *common, "--replay", "--policy", "youdens-j", "--hard", "Persian", "--positive-figures", "http://photos/p"], spark) == 0
    (made,) = [p.name for p in (tmp_path / "a").iterdir()]
    assert made == "calibration-three-way-seed20240601-g15-c10-t10-m--one-detect-m0.1-youdens-j"
    document, _ = artifact.read_artifact(spark, str(tmp_path / "a" / made))
    (page,) = [p for p in (tmp_path / "r").iterdir() if p.suffix == ".html"]
    text = page.read_text()
    assert page.name == "report-three-way-seed20240601-g15-c10-t10-m--one-detect-m0.1-max.html" and "15 references" in text
    assert text.count('src="http://photos/p/') >= 15 + 20 and 'src="../img/Persian/n' in text and "picture" not in text
    assert cli.main(["evaluate", *common, "--external"], spark) == 0
    assert f"Evaluation at {document['threshold']}" in capsys.readouterr().out and (tmp_path / "r" / f"external-three-way-seed20240601-g15-c10-t10-m--one-detect-m0.1-{document['aggregation']}.html").exists()


def test_tables_of_a_run_are_deleted(spark, stored):
    import os

    from simgate.sources.shared import folder_of, kept, scope

    folder = folder_of(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    args = ["evaluate", "--positives", f"{stored}/pos", "--negatives", f"{stored}/neg", "--split", f"{stored}/split", "--artifact", f"{stored}/artifact"]
    assert cli.main(args, spark) == 0 and set(os.listdir(folder)) == before
    with pytest.raises(KeyError), scope(spark):
        kept(spark.range(3), "lost")
        raise KeyError("stop")
    own = kept(spark.range(3), "mine")
    assert own.count() == 3 and len(set(os.listdir(folder)) - before) == 1
