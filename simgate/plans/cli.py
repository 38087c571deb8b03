"""python -m simgate.plans.cli build|detect|calibrate|evaluate ...: caches and detections from pictures, and runs over caches."""

from __future__ import annotations

import argparse
import secrets
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from simgate.operators import guards, scoring, thresholds
from simgate.plans import build, report
from simgate.plans import calibrate as runs
from simgate.sources import cache, files, shared


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="simgate")
    commands = p.add_subparsers(dest="command", required=True)
    c, e = commands.add_parser("calibrate"), commands.add_parser("evaluate")
    for own in (c, e):
        own.add_argument("--positives", required=True, help="folder of the positives' cache")
        own.add_argument("--negatives", required=True, help="folder of the negatives' cache")
        own.add_argument("--split", help="folder of the stored split")
        own.add_argument("--artifact", help="folder of the artifact")
        own.add_argument("--html")
        own.add_argument("--scores-out")
    for name, kind in (("reference", int), ("calibration", int), ("test", int), ("test-fraction", float), ("seed", int)):
        c.add_argument(f"--{name}", type=kind)
    c.add_argument("--random-seed", action="store_true")
    c.add_argument("--replay", action="store_true", help="use the stored split instead of drawing one")
    c.add_argument("--generate-only", action="store_true")
    c.add_argument("--aggregation", choices=scoring.AGGREGATIONS, default="max")
    c.add_argument("--policy", choices=thresholds.POLICIES)
    c.add_argument("--target-fpr", type=float, default=runs.TARGET_FPR)
    c.add_argument("--target-group", choices=thresholds.GROUPS, default="hard")
    c.add_argument("--hard", nargs="*", default=list(runs.HARD_GROUPS))
    c.add_argument("--prefer", choices=runs.PREFERENCES, help="reference and calibration photos that show this come first")
    c.add_argument("--attributes", help="CSV of the positives' attributes")
    for own in (c, e):
        own.add_argument("--model", help="the model that both caches must be made with")
        own.add_argument("--no-detect", action="store_true")
        own.add_argument("--margin", type=float)
        own.add_argument("--figures", help="folder or address of the negatives' pictures, for the HTML report")
        own.add_argument("--positive-figures", help="that of the positives and references; else the same")
        own.add_argument("--nested-figures", action="store_true", help="pictures lie in a folder for each group")
        own.add_argument("--artifacts", help="folder of artifacts: without --artifact, a new one is named in it, or the last by name is taken")
        own.add_argument("--reports", help="folder in which the HTML report gets a name of its own")
    c.add_argument("--sweep-step", type=float, default=runs.SWEEP_STEP)
    b, d = commands.add_parser("build"), commands.add_parser("detect")
    for own in (b, d):
        own.add_argument("--images", required=True, help="folder of the pictures")
        own.add_argument("--detector", help="module:name of what loads the detector")
        own.add_argument("--cut", help="module:name of what cuts a box from a picture")
        own.add_argument("--min-confidence", type=float, default=build.MIN_CONFIDENCE)
        own.add_argument("--margin", type=float, default=build.MARGIN)
    b.add_argument("--source", choices=("folder", "groups", "annotations"), default="folder", help="how pictures lie: in one folder, a folder for each group, or as a list says")
    b.add_argument("--annotations", help="the list of annotated pictures")
    b.add_argument("--catalog", help="where to write the names and groups of all pictures")
    b.add_argument("--catalog-only", action="store_true")
    b.add_argument("--out", help="root of the caches; the variant gives the folder below it")
    b.add_argument("--model", help="identity of the embedder")
    b.add_argument("--embedder", help="module:name of what loads the embedder")
    b.add_argument("--no-detect", action="store_true", help="embed whole pictures")
    b.add_argument("--batch-size", type=int, default=build.inference.BATCH)
    b.add_argument("--per-group", type=int, default=0)
    b.add_argument("--limit", type=int)
    b.add_argument("--seed", type=int, default=0)
    d.add_argument("--crops", help="folder for the crops, which all executors mount")
    d.add_argument("--all-crops", action="store_true", help="save all crops, not just the surest")
    d.add_argument("--csv", help="where to write a line for each detection")
    e.add_argument("--external", action="store_true", help="grade on the whole cache of negatives")
    e.add_argument("--single-group")
    e.add_argument("--hard", nargs="*", help="hard groups, in place of the artifact's or the external ones")
    return p


def settings(args: argparse.Namespace) -> runs.Settings:
    drawn = {k: getattr(args, k) for k in ("reference", "calibration", "test", "test_fraction", "seed", "prefer")}
    if args.replay:
        guards.exclusive(drawn | {"random_seed": args.random_seed}, "a replayed split")
    if args.random_seed:
        guards.exclusive({"seed": args.seed}, "a random seed")
        drawn["seed"] = secrets.randbelow(2**31)
    kept = {k: v for k, v in drawn.items() if v is not None}
    return runs.Settings(**kept, aggregation=args.aggregation, policy=args.policy, target_fpr=args.target_fpr, target_group=args.target_group, step=args.sweep_step, hard=args.hard)


def requested(args: argparse.Namespace, identity: dict) -> dict:
    """The variant that the options ask for; what they leave open is as the cache has it."""
    asked = dict(identity)
    if args.model is not None:
        asked["model_id"] = args.model
    if args.no_detect:
        asked |= {"detect": False, "margin": None, "min_confidence": None}
    if args.margin is not None:
        guards.require(not args.no_detect, "a margin needs the detector")
        asked |= {"detect": True, "margin": args.margin}
    return asked


def chosen_artifact(spark: SparkSession, args: argparse.Namespace) -> str | None:
    """The artifact that an evaluation reads: the one named, else the last by name in the folder of artifacts."""
    if args.artifact or not args.artifacts:
        return args.artifact
    found = runs.artifacts.find_artifacts(spark, args.artifacts)
    guards.require(bool(found), f"there is no artifact in {args.artifacts}; calibrate first")
    return found[-1]


def new_artifact(args: argparse.Namespace, own: runs.Settings, identity: dict) -> str | None:
    """Where a calibration freezes its choice: as named, else under a name of its own in the folder of artifacts."""
    if args.artifact or not args.artifacts or own.policy is None:
        return args.artifact
    return f"{args.artifacts.rstrip('/')}/{runs.artifacts.default_name('calibration', vars(own), identity, own.policy)}"


def _named(rows):
    return rows.withColumn("name", F.col("source_filename"))


def pictures(spark: SparkSession, args: argparse.Namespace):
    if args.source == "folder":
        return files.image_folder(spark, args.images)
    if args.source == "groups":
        return files.grouped_images(spark, args.images)
    guards.require(args.annotations is not None, "annotated pictures need their list")
    listed = files.annotations(spark, args.annotations)
    return listed.join(files.image_folder(spark, args.images).drop("content"), "source_filename")


def build_run(spark: SparkSession, args: argparse.Namespace) -> None:
    images = pictures(spark, args)
    if args.catalog:
        guards.require("group" in images.columns, "a catalog needs groups")
        files.write_catalog(images, args.catalog)
    if args.catalog_only:
        return
    guards.require(bool(args.out and args.model and args.embedder), "a cache needs --out, --model and --embedder")
    guards.require(args.no_detect or bool(args.detector and args.cut), "a detector and a cut must be named, or --no-detect given")
    folder = cache.variant_dir(args.out, args.model, not args.no_detect, args.margin)
    detector, cut = (None, None) if args.no_detect else (build.named(args.detector), build.named(args.cut))
    chosen = build.sampled(images, args.per_group, args.limit, args.seed)
    used = build.build_cache(chosen, folder, args.model, build.named(args.embedder), detector, cut, args.margin, args.min_confidence, args.batch_size)
    print(report.text_table(f"Cache {folder}", report.rows_of(used.orderBy("status"))))


def detect_run(spark: SparkSession, args: argparse.Namespace) -> None:
    guards.require(bool(args.detector and args.cut), "a detector and a cut must be named")
    found = build.detected(files.image_folder(spark, args.images), build.named(args.detector), build.named(args.cut), args.margin, args.min_confidence, args.all_crops)
    if args.crops:
        build.write_crops(found, args.crops)
    if args.csv:
        build.write_detections(found, args.csv)
    for row in build.described(found).orderBy("name").toLocalIterator():
        print(row["text"])
    print(build.detection_summary(found))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("simgate").getOrCreate()
    with shared.scope(spark):
        return command(spark, args)


def command(spark: SparkSession, args: argparse.Namespace) -> int:
    """Run one command; 0, or 2 where a guard does not hold."""
    try:
        if args.command in ("build", "detect"):
            (build_run if args.command == "build" else detect_run)(spark, args)
            return 0
        positives, identity = cache.read_cache(spark, args.positives)
        guards.same_variant(requested(args, identity), identity, "the request and the positives' cache")
        negatives, _ = cache.read_cache(spark, args.negatives, identity)
        positives, negatives = _named(positives), _named(negatives)
        if args.command == "calibrate":
            own = settings(args)
            records = None
            if args.attributes:
                attributes = files.attribute_table(spark, args.attributes)
                guards.require(attributes is not None, f"there is no attribute table {args.attributes}")
                records = files.positive_records(positives, attributes).withColumnRenamed("source_filename", "name")
            if args.generate_only:
                guards.require(args.split is not None, "a split to generate needs a folder")
                guards.require(own.prefer is None or records is not None, "a preference needs the positives' attributes")
                named = positives.select("name") if own.prefer is None else positives.select("name").join(records, "name")
                roles = runs.make_split(named, negatives.select("name", "group"), own)
                runs.split_store.write_split(roles, args.split, identity, vars(own))
                return 0
            run = runs.calibrate(spark, positives, negatives, identity, own, args.split, new_artifact(args, own, identity), poses=records, replay=args.replay, records=records)
            header, sections, rows = f"Calibration, seed {own.seed}, {own.aggregation}", report.calibration_sections(run, own.hard, args.nested_figures), run["scored"]
            drawn, kind, rest = vars(own), "report", (own.aggregation,)
        else:
            frozen = chosen_artifact(spark, args)
            guards.require(bool(frozen and args.split), "an evaluation needs an artifact and its split")
            external = negatives if args.external else None
            run = runs.evaluate(spark, frozen, args.split, positives, negatives, identity, external, args.single_group, args.hard)
            header, sections, rows = f"Evaluation at {run['document']['threshold']}", report.evaluation_sections(run, args.nested_figures), run["export"]
            drawn, kind, rest = run["parameters"], "external" if args.external else "evaluation", (run["document"]["aggregation"],)
        print(report.as_text(header, sections))
        page = args.html
        if not page and args.reports:
            page = f"{args.reports.rstrip('/')}/{runs.artifacts.default_name(kind, drawn, identity, *rest)}.html"
        if page:
            folders = report.Folders(args.figures, args.positive_figures or args.figures, page) if args.figures else None
            files.write_text(spark, page, report.as_html(header, sections, folders, run["roles"].where("role = 'reference'").select("ord", "name")))
        if args.scores_out:
            columns = ["role", F.col("name").alias("source_filename"), F.format_string("%.6f", "score").alias("score"), *(["verdict"] if "verdict" in rows.columns else []), "best_match", "group"]
            rows.select(*columns).write.mode("overwrite").csv(args.scores_out, header=True)
        return 0
    except guards.GuardError as error:
        print(f"error: {error}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
