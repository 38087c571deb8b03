"""Reproducible, stratified role membership by the order of a seeded digest.

A name's place depends on seed and name alone, so membership never depends on row order, and the
test set is drawn first: no later choice changes it. Places are numbered by ranges of digests, so
neither all names nor a group of most names meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from simgate.operators import guards, ranges


#: Parts of a group from which a sample is drawn on its own first.
SALTS = 64


def shuffle_key(seed: int, *parts: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(p.cast("string") for p in parts)))


def test_first(names: DataFrame, seed: int, test: int, key: str = "name") -> DataFrame:
    """Add shuffle_rank and is_test (the first ``test`` in shuffled order)."""
    ranked = ranges.placed(names, {"digest": shuffle_key(seed, F.col(key)), "key": F.col(key)}, "shuffle_rank")
    return ranked.withColumn("is_test", F.col("shuffle_rank") <= test)


def prefer(ranked: DataFrame, flag: Column, key: str = "name") -> DataFrame:
    """Reorder what is left after the test draw: preferred rows first, else shuffled order; adds setup_rank."""
    left = ranked.where("NOT is_test")
    return ranges.placed(left, {"later": ~F.coalesce(flag, F.lit(False)), "shuffle_rank": F.col("shuffle_rank")}, "setup_rank")


def positive_roles(positives: DataFrame, seed: int, reference: int, calibration: int, test: int, prefer_flag: Column | None = None, key: str = "name") -> DataFrame:
    """(key, role, ord): reference and calibration follow each other in setup order; leftovers have no role.

    Only members of roles are taken, the first of each order, so the driver holds as many names as the roles have.
    """
    later = ~F.coalesce(prefer_flag, F.lit(False)) if prefer_flag is not None else F.lit(False)
    keyed = positives.select(key, later.alias("later"), shuffle_key(seed, F.col(key)).alias("digest"))
    asked = reference + calibration + test
    first = keyed.orderBy("digest", key).limit(asked).collect()
    guards.counts_fit(len(first) if len(first) < asked else max(asked, 0), reference, calibration, test)
    drawn = [r[key] for r in first[:test]]
    setup = [r[key] for r in first[test:]]
    if prefer_flag is not None:
        setup = [r[key] for r in keyed.where(~F.col(key).isin(drawn)).orderBy("later", "digest", key).limit(reference + calibration).collect()]
    rows = [(n, role, i + 1) for role, names in (("reference", setup[:reference]), ("calibration", setup[reference:]), ("test", drawn)) for i, n in enumerate(names)]
    kind = positives.schema[key].dataType.simpleString()
    return positives.sparkSession.createDataFrame(rows, f"`{key}` {kind}, role string, ord int")


def stratified(negatives: DataFrame, seed: int, test_fraction: float, key: str = "name", group: str = "group") -> DataFrame:
    """(key, group, role, ord): of each group round(n * fraction), half to even, are test."""
    guards.fraction(test_fraction, "the test fraction")
    ranked = ranges.placed_within(negatives.select(key, group), group, {"digest": shuffle_key(seed, F.col(group), F.col(key)), "key": F.col(key)}, "ord")
    take = F.bround(F.col("n") * F.lit(float(test_fraction)), 0)
    return ranked.select(key, group, F.when(F.col("ord") <= take, "test").otherwise("setup").alias("role"), "ord")


def sample_per_group(rows: DataFrame, limit: int, seed: int, key: str = "name", group: str = "group") -> DataFrame:
    """At most ``limit`` rows of each group (0 or less: all)."""
    if limit <= 0:
        return rows
    order = [shuffle_key(seed, F.col(group), F.col(key)), F.col(key)]
    first = lambda df, *by: df.withColumn("sample_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("sample_rank") <= limit).drop("sample_rank")
    salted = first(rows.withColumn("sample_salt", F.pmod(F.xxhash64(key), F.lit(SALTS))), group, "sample_salt")  # at most limit * SALTS rows of a group are left
    return first(salted.drop("sample_salt"), group)


def three_way(positives: DataFrame, negatives: DataFrame, seed: int, reference: int, calibration: int, test: int, test_fraction: float, prefer_flag: Column | None = None) -> DataFrame:
    """The whole split: (dataset, role, ord, name, group). Whether roles are disjoint is for whoever stores it to check, on what is stored."""
    pos = positive_roles(positives, seed, reference, calibration, test, prefer_flag).select(F.lit("positive").alias("dataset"), "role", "ord", F.col("name").cast("string").alias("name"), F.lit(None).cast("string").alias("group"))
    neg = stratified(negatives, seed, test_fraction).select(F.lit("negative").alias("dataset"), "role", "ord", F.col("name").cast("string").alias("name"), F.col("group").cast("string").alias("group"))
    return pos.union(neg)


def group_counts(rows: DataFrame, group: str = "group") -> DataFrame:
    return rows.groupBy(group).agg(F.count(F.lit(1)).alias("n")).orderBy(group)


def role_summary(roles: DataFrame) -> DataFrame:
    return roles.groupBy("dataset", "role").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("name").alias("names"))


def overlaps(roles: DataFrame) -> DataFrame:
    """Names in more than one role of a dataset, or twice in one."""
    return roles.groupBy("dataset", "name").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("role").alias("roles")).where("n > 1")
