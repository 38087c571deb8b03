"""Near-duplicate documents by min-max hashing.

Every permutation of the shingle hashes gives its minimum and its maximum, so 64 hash evaluations
make a signature of 128 values, compared in 32 bands of four. Documents of equal words are one
class; of each class one document goes on. Small buckets give all their pairs; a larger bucket gives
a pair of each member with its most central member (the one whose buckets are fullest). Every pair
is confirmed on the full shingle sets, and components of the confirmed links are found in rounds of
joins. What these pairs leave apart is settled at last: in each larger bucket that holds several
components, every member outside of the fullest one is compared on the full sets with every member
of another, in pairs of blocks, of which only links that join components come back. So two documents
that share a bucket and are similar enough are in one component, however large the bucket is, and no
group gives rows for all its pairs.

Defined results: a null or empty text, or one without words, has no shingles and stands alone; a
text of fewer words than a shingle is one shingle; repeated rows get equal results; rows that share
an id but not the text count as linked; a row without an id is kept and has no component; other
columns are dropped by ``near_duplicates``; ``kept`` is true for the smallest id of a component.
``deduplicated`` keeps all columns and one row of each component, rows without an id and repeated
ids included.
"""

from __future__ import annotations

import uuid
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simgate.llm import minmax
from simgate.llm.components import components
from simgate.llm.shared import discard, written
from simgate.llm.tables import documents, map_texts

#: Members up to which a bucket gives all its pairs (28). Links do not depend on it, only what finding them costs.
SMALL = 8
#: A link: 100 * intersection >= LINK * union.
LINK = 80
#: Shingles of one block of a bucket; two blocks meet in a task.
BLOCK = 400_000


def bucket_pairs(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) to compare from (bucket, doc) rows, and the rows of buckets over SMALL, as tables."""
    sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("low"), F.max("doc").alias("high")).where("n > 1")
    sizes = written(sizes, "buckets")
    two = sizes.where("n = 2 AND low < high").select(F.col("low").alias("a"), F.col("high").alias("b"))
    more = written(rows.join(sizes.where("n > 2").select("bucket", "n"), "bucket"), "members")
    few = more.where(F.col("n") <= SMALL).groupBy("bucket").agg(F.sort_array(F.collect_set("doc")).alias("docs"))  # at most SMALL
    few = few.select(F.explode("docs").alias("a"), "docs").select("a", F.explode("docs").alias("b")).where("a < b")
    many = more.where(F.col("n") > SMALL)
    central = many.groupBy("doc").agg(F.sum("n").alias("weight"))
    hubs = many.join(central, "doc").groupBy("bucket").agg(F.max_by("doc", F.struct("weight", -F.col("doc"))).alias("hub"))
    star = many.join(hubs, "bucket").where("doc <> hub").select(F.least("doc", "hub").alias("a"), F.greatest("doc", "hub").alias("b"))
    out = written(two.union(few).union(star).distinct(), "pairs"), written(many.select("bucket", "doc").distinct(), "large")
    discard(sizes, more)
    return out


def confirmed(pairs: DataFrame, sets: DataFrame, link: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    left = sets.select(F.col("doc").alias("a"), F.col("shingles").alias("own"))
    right = sets.select(F.col("doc").alias("b"), F.col("shingles").alias("other"))
    both = pairs.hint("merge").join(left.hint("merge"), "a").join(right.hint("merge"), "b")  # sides that grow with the input
    shared = F.size(F.array_intersect("own", "other"))
    return both.where(100 * shared >= link * (F.size("own") + F.size("other") - shared)).select("a", "b").distinct()


def joining_links(docs: list, labels: list, sides: np.ndarray, values: np.ndarray, sizes: np.ndarray, main: int, link: int) -> list[tuple]:
    """Links of documents of side 0 with those of side 1 and other labels, enough of them to join all labels that any such link joins.

    A document that has joined the main label is done: whatever else it may be linked with is compared with it on its own turn.
    """
    names, label = np.unique(labels, return_inverse=True)
    fullest = int(np.searchsorted(names, main)) if main in names else -1
    ids = np.unique(values, return_inverse=True)[1]
    ends = np.cumsum(sizes)
    begins, inside = ends - sizes, np.zeros(int(ids.max()) + 1, np.int32)
    rights = sides == 1
    out = []
    for d in np.flatnonzero(~rights).tolist():
        if label[d] == fullest:
            continue
        own = ids[begins[d] : ends[d]]
        inside[own] = 1
        shared = np.add.reduceat(inside[ids], begins)
        inside[own] = 0
        near = np.flatnonzero(rights & (label != label[d]) & (100 * shared >= link * (sizes + sizes[d] - shared)))
        for other in near[np.unique(label[near], return_index=True)[1]].tolist():
            out.append((docs[d], docs[other]))
            mine, its = label[d], label[other]
            label[label == (mine if its == fullest else its)] = its if its == fullest else mine
    return out


def links_across(rows: DataFrame, sets: DataFrame, found: DataFrame, link: int) -> DataFrame:
    """Links (a, b) between components that meet in one of the buckets of rows (bucket, doc), as a table."""
    label = F.coalesce("component", "doc").alias("label")
    held = sets.select("doc", F.size("shingles").cast("long").alias("size")).join(rows.select("doc").distinct().hint("merge"), "doc", "left_semi")
    held = held.join(found.withColumnRenamed("node", "doc").hint("merge"), "doc", "left").select("doc", "size", label)
    held = labelled = written(rows.join(held.hint("merge"), "doc"), "labelled")
    parts = held.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    mixed = parts.groupBy("bucket").agg(F.count(F.lit(1)).alias("labels"), F.sum("size").alias("all"), F.max(F.struct("n", "size", "label")).alias("main")).where("labels > 1")
    blocks = lambda size: F.ceil(size / BLOCK).cast("int")
    mixed = mixed.select("bucket", F.col("main.label").alias("main"), blocks(F.col("all") - F.col("main.size")).alias("lefts"), blocks(F.col("all")).alias("rights"))
    held = held.select("bucket", "doc", "label").join(mixed, "bucket")
    block, upto = lambda n: F.pmod(F.xxhash64("doc"), n).cast("int"), lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    outside = held.where("label <> main").select("bucket", block("lefts").alias("i"), upto("rights").alias("j"), "doc", "label", "main", F.lit(0).alias("side"))
    every = held.select("bucket", upto("lefts").alias("i"), block("rights").alias("j"), "doc", "label", "main", F.lit(1).alias("side"))
    met = outside.union(every).hint("merge").join(sets.select("doc", "shingles").hint("merge"), "doc")
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        lists = group.column("shingles").combine_chunks()
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        column = lambda name: group.column(name).to_numpy()
        links = joining_links(group.column("doc").to_pylist(), group.column("label").to_pylist(), column("side"), lists.flatten().to_numpy(zero_copy_only=False), sizes, int(column("main")[0]), link)
        return pa.table([[min(p) for p in links], [max(p) for p in links]], schema=out)

    across = written(met.groupBy("bucket", "i", "j").applyInArrow(run, "a long, b long").distinct(), "across")
    discard(labelled)
    return across


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", link: int = LINK, shingle: int = minmax.SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    docs = df.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    first = written(map_texts(docs, lambda: partial(minmax.described, n=shingle), "n_shingles long, key_a long, key_b long, bands array<long>", "doc"), "signatures")
    full = first.where("n_shingles > 0 AND doc IS NOT NULL")
    classes = full.groupBy("key_a", "key_b").agg(F.min("doc").alias("class"))
    members = written(full.select("doc", "key_a", "key_b").join(classes, ["key_a", "key_b"]).select("doc", "class").distinct(), "classes")
    heads = members.where("doc = class").select("doc")
    rows = full.join(heads.hint("merge"), "doc", "left_semi").dropDuplicates(["doc", "key_a", "key_b"]).select("doc", F.explode("bands").alias("bucket"))

    pairs, large = bucket_pairs(rows)
    needed = pairs.select(F.explode(F.array("a", "b")).alias("doc")).distinct()
    sets = written(map_texts(docs.join(needed.hint("merge"), "doc", "left_semi"), lambda: partial(minmax.sets, n=shingle), "shingles array<long>", "doc"), "sets")
    links = written(confirmed(pairs, sets, link).union(crossing(members)), "links")

    found = components(links)
    across = links_across(large, sets, found, link)
    if not across.isEmpty():
        found = components(links.union(across))
    discard(pairs, large, sets, links, across)
    whole = members.join(found, F.col("class") == F.col("node"), "left").select("doc", F.coalesce("component", "class").alias("component_id"))
    whole = whole.groupBy("doc").agg(F.min("component_id").alias("component_id"))
    out = first.select(F.col("doc"), "n_shingles").join(whole, "doc", "left")
    component = F.when(F.col("doc").isNotNull(), F.coalesce("component_id", "doc"))
    return out.select(F.col("doc").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc") == component, F.lit(True)).alias("kept"))


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", link: int = LINK, shingle: int = minmax.SHINGLE) -> DataFrame:
    """One row, with all columns, of each component of near duplicates; every row without words.

    The row with the smallest id stays. Rows without an id, or whose id stands more than once, get numbers of their own
    above all ids for the comparison.
    """
    key = f"row_{uuid.uuid4().hex}"
    given = F.col(f"`{id_col}`").cast("long")
    ids = df.select(given.alias("id"))
    again = written(ids.groupBy("id").count().where("count > 1 OR id IS NULL").select("id"), "repeated_ids")
    rows = df.withColumn(key, given)
    if not again.isEmpty():
        top = ids.agg(F.max("id")).first()[0] or 0
        marked = again.withColumnRenamed("id", key).withColumn(f"{key}_again", F.lit(True))
        split = rows.join(marked.withColumnRenamed(key, f"{key}_id"), F.col(key).eqNullSafe(F.col(f"{key}_id")), "left").drop(f"{key}_id")
        number = F.when(F.col(f"{key}_again"), F.lit(top) + 1 + F.monotonically_increasing_id()).otherwise(F.col(key))
        rows = written(split.withColumn(key, number).drop(f"{key}_again"), "numbered")
    gone = near_duplicates(rows.select(F.col(key).alias("doc_id"), F.col(f"`{text_col}`").alias("text")), link=link, shingle=shingle).where("NOT kept").select(F.col("doc_id").alias(key))
    return rows.join(gone.hint("merge"), key, "left_anti").select(*(f"`{c}`" for c in df.columns))


def crossing(members: DataFrame) -> DataFrame:
    """Links between the classes of an id that stands in several (rows that share an id but not the text)."""
    several = members.groupBy("doc").agg(F.min("class").alias("a"), F.max("class").alias("b"), F.array_sort(F.collect_set("class")).alias("own"))
    return several.where("a <> b").select("a", F.explode("own").alias("b")).where("a <> b")


def op7_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


OP7_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 3], ' ') END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2) p
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * shared >= 80 * (na.n + nb.n - shared)),
reach AS (SELECT a AS doc_id, b AS other FROM links UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a),
low AS (SELECT doc_id, min(other) AS other FROM reach GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(low.other, d.doc_id)) AS component_id,
  d.doc_id = least(d.doc_id, coalesce(low.other, d.doc_id)) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN low USING (doc_id)
"""
