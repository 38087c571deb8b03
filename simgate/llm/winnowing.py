"""Benchmark decontamination by winnowing.

Of the hashes of all 5-word grams of a text, the least in each run of nine is kept (of equal ones
the rightmost). Two texts that share 13 words share such a run, so both keep the same gram at the
same place: no shared span of 13 words is missed. Fingerprints that both sides have are extended:
each window of 13 words around them is compared word by word with the windows of the items.

Items of fewer than 13 words are one window each; they are looked up by the hash of all their words.

``contamination`` reads a benchmark of up to ``BROADCAST_BYTES`` of text as one broadcast index and
documents in one pass without a shuffle. A larger benchmark is joined (``by_join``): fingerprints
of documents with the distinct ones of the items, then the windows around those that both have with
the items' windows, a row for each window with the list of its items. Both give the same rows.

Defined results: a null or empty text has no words and no hits, and its item list is empty; a text
of fewer words than a window can only match short items; items without id or words are ignored;
items of equal text all count; every row is judged by its own text, whatever its id: repeated rows
give repeated rows, a null id stays null; ``contamination`` drops other columns and ``clean`` keeps
them, whatever their names; an empty benchmark leaves all documents clean.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simgate.llm.shared import written
from simgate.llm.tables import byte_slices, documents, filter_texts, map_texts, table
from simgate.llm.words import ALPHANUMERIC, Words

WINDOW, GRAM = 13, 5
#: Text of a benchmark that is sent to every executor; a larger one is joined.
BROADCAST_BYTES = 4 << 20
SCHEMA = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def winnow(words: Words) -> np.ndarray:
    """Numbers of the words at which a kept gram begins, and the hashes of all grams."""
    grams, run = words.grams(GRAM), WINDOW - GRAM + 1
    n = len(grams)
    begins = np.flatnonzero(words.left >= WINDOW)
    if not len(begins):
        return begins, grams
    least = grams[begins]
    for i in range(1, run):
        np.minimum(least, grams[begins + i], out=least)
    at = begins.copy()
    for i in range(1, run):
        at = np.where(grams[begins + i] == least, begins + i, at)
    kept = np.zeros(n, bool)
    kept[at] = True
    return np.flatnonzero(kept), grams


class Index:
    """Fingerprints and windows of items."""

    def __init__(self, items: list[tuple[str, str]]):
        words = Words([t for _, t in items], ALPHANUMERIC)
        holders: dict[bytes, set[str]] = {}
        self.short: dict[int, np.ndarray] = {}
        short: dict[int, list[int]] = {}
        for k, (name, _) in enumerate(items):
            first, size = int(words.first[k]), int(words.sizes[k])
            if size >= WINDOW:
                for i in range(first, first + size - WINDOW + 1):
                    holders.setdefault(words.window(i, WINDOW), set()).add(name)
            elif size:
                holders.setdefault(words.window(first, size), set()).add(name)
                short.setdefault(size, []).append(first)
        at, grams = winnow(words)
        self.long = np.unique(grams[at])
        for size, firsts in short.items():
            self.short[size] = np.unique(words.grams(size)[firsts])
        same: dict[frozenset, frozenset] = {}
        self.holders = {w: same.setdefault(f := frozenset(s), f) for w, s in holders.items()}

    def hits(self, words: Words) -> list[tuple[int, int, frozenset]]:
        """(first word, number of words, items) of all windows that occur."""
        return [(i, size, h) for i, size in candidates(words, self.long, self.short) if (h := self.holders.get(words.window(i, size)))]


def candidates(words: Words, long: np.ndarray, short: dict[int, np.ndarray]) -> Iterator[tuple[int, int]]:
    """(first word, number of words) of the windows to compare: around known fingerprints, and at hashes of short items."""
    if len(long):
        at, grams = winnow(words)
        at = at[among(grams[at], long)]
        spread = np.unique((at[:, None] - np.arange(WINDOW - GRAM + 1)).ravel())  # extend to all windows around
        spread = spread[spread >= 0]
        for i in spread[words.left[spread] >= WINDOW].tolist():
            yield i, WINDOW
    for size, hashes in short.items():
        at = np.flatnonzero(words.left >= size)
        for i in at[among(words.grams(size)[at], hashes)].tolist():
            yield i, size


def among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def judge(words: Words, found: list[tuple[int, int, frozenset]]) -> dict:
    """The result columns of each text."""
    n = len(words.sizes)
    hit = np.zeros(len(words.starts) + 1, np.int64)
    items: list[set] = [set() for _ in range(n)]
    for i, size, holders in found:
        hit[i] += 1
        hit[i + size] -= 1
        items[words.owner[i]].add(holders)
    covered = np.concatenate(([0], np.cumsum(np.cumsum(hit[:-1]) > 0)))
    n_hit = covered[words.first[1:]] - covered[words.first[:-1]]
    named = [sorted(frozenset().union(*s)) for s in items]
    return {
        "n_words": words.sizes, "n_hit": n_hit, "n_items": [len(s) for s in named],
        "items_sha256": [hashlib.sha256(",".join(s).encode()).hexdigest() for s in named],
        "contaminated": (n_hit > 0) & (20 * n_hit >= words.sizes),
    }


def named_items(benchmark: DataFrame) -> DataFrame:
    picked = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("item"))
    return picked.dropna()


def broadcast_index(df: DataFrame, items: DataFrame, broadcast_bytes: int):
    """The index of the items, sent to every executor; None if they are too large for that."""
    size = items.agg(F.sum(F.octet_length("item"))).first()[0] or 0
    if size > broadcast_bytes:
        return None
    return df.sparkSession.sparkContext.broadcast(Index([tuple(r) for r in items.toLocalIterator()]))


def contamination(df: DataFrame, benchmark: DataFrame, broadcast_bytes: int = BROADCAST_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The contract's columns for every document."""
    items = named_items(benchmark)
    index = broadcast_index(df, items, broadcast_bytes)
    if index is None:
        rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
        rows = written(rows, "rows")
        judged = rows.select("id", "row").join(by_join(rows.select("row", "text"), items).withColumnRenamed("row", "judged"), F.col("row") == F.col("judged"))
        return judged.select(F.col("id").alias(id_col), *(f.split()[0] for f in SCHEMA.split(", ")))

    def make() -> Callable[[list], dict]:
        def fn(texts: list) -> dict:
            words = Words(texts, ALPHANUMERIC)
            return judge(words, index.value.hits(words))

        return fn

    return map_texts(df, make, SCHEMA, id_col, text_col)


def clean(df: DataFrame, benchmark: DataFrame, broadcast_bytes: int = BROADCAST_BYTES, text_col: str = "text") -> DataFrame:
    """The rows of df, with all their columns, that aren't contaminated."""
    items = named_items(benchmark)
    index = broadcast_index(df, items, broadcast_bytes)
    if index is None:
        row = f"row_{uuid.uuid4().hex}"
        rows = written(df.withColumn(row, F.monotonically_increasing_id()), "rows")
        judged = by_join(rows.select(F.col(row).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text")), items)
        return rows.join(judged.where("contaminated").select(F.col("row").alias(row)), row, "left_anti").select(*(f"`{c}`" for c in df.columns))

    def make() -> Callable[[list], list]:
        def fn(texts: list) -> list:
            words = Words(texts, ALPHANUMERIC)
            return ~judge(words, index.value.hits(words))["contaminated"]

        return fn

    return filter_texts(df, make, text_col)


def lists(owner: np.ndarray, values: np.ndarray, n: int) -> list[np.ndarray]:
    """The distinct values of each of n owners."""
    order = np.argsort(owner, kind="stable")
    cuts = np.searchsorted(owner[order], np.arange(n + 1))
    values = values[order]
    return [np.unique(values[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def by_join(rows: DataFrame, items: DataFrame) -> DataFrame:
    """row and the contract's columns for every (row, text), for a benchmark that is too large to send everywhere."""
    numbered = items.select(F.lit(0).alias("row"), F.col("item").alias("text"), F.col("item_id").alias("name"))

    def sizes() -> Callable[[list], dict]:
        return lambda texts: {"size": Words(texts, ALPHANUMERIC).sizes}

    short = map_texts(numbered, sizes, "size long", "row").select("size").where(F.col("size").between(1, WINDOW - 1)).distinct()
    short = sorted(r[0] for r in short.collect())  # at most 12

    def prints(own: bool) -> Callable[[], Callable[[list], dict]]:
        def fn(texts: list) -> dict:
            words = Words(texts, ALPHANUMERIC)
            at, grams = winnow(words)
            owner, value = [words.owner[at]], [grams[at]]
            for size in short:
                begins = np.flatnonzero(words.left >= size)
                if own:  # an item: only if that is all of it
                    begins = words.first[:-1][words.sizes == size]
                owner.append(words.owner[begins])
                value.append(words.grams(size)[begins])
            return {"prints": lists(np.concatenate(owner), np.concatenate(value).view(np.int64), len(texts))}

        return lambda: fn

    known = written(map_texts(numbered, prints(True), "prints array<long>", "row").select(F.explode("prints").alias("print")).distinct(), "prints")
    own = map_texts(rows, prints(False), "prints array<long>", "row").select("row", F.explode("prints").alias("print"))
    own = own.join(known.hint("merge"), "print", "left_semi").groupBy("row").agg(F.collect_set("print").alias("prints"))  # of one text
    offered = rows.join(own.hint("merge"), "row").select("row", "text", "prints")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in byte_slices(batch.column(1)):
                part = batch.slice(a, b - a)
                out: dict[str, list] = {"row": [], "first": [], "size": [], "window": []}
                for row, text, own in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    words, wanted = Words([text], ALPHANUMERIC), np.unique(np.array(own, np.int64).view(np.uint64))
                    for i, size in candidates(words, wanted, dict.fromkeys(short, wanted)):
                        for name, value in zip(out, (row, i, size, words.window(i, size).decode()), strict=True):
                            out[name].append(value)
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.string() if k == "window" else pa.int64()) for k, v in out.items()], names=list(out))

    def item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in byte_slices(batch.column(0)):
                part = batch.slice(a, b - a)
                found = []
                for text, name in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    words = Words([text], ALPHANUMERIC)
                    n = min(WINDOW, len(words.starts))
                    found += [(words.window(i, n).decode(), name) for i in range(len(words.starts) - n + 1)] if n else []
                columns = list(zip(*found, strict=True)) or [(), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["window", "name"])

    holders = numbered.select("text", "name").mapInArrow(item_windows, "window string, name string").groupBy("window").agg(F.collect_set("name").alias("names"))
    tried = offered.mapInArrow(windows, "row long, first long, size long, window string")
    hits = tried.join(written(holders, "windows").hint("merge"), "window").groupBy("row").agg(
        F.array_sort(F.collect_set(F.struct("first", "size"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("names")))).alias("names")
    )
    # words covered: spans in order, each from where those before it end
    covered = F.aggregate(
        "spans", F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n")),
        lambda acc, s: F.struct(F.greatest(acc["end"], s["first"] + s["size"]).alias("end"), (acc["n"] + F.greatest(s["first"] + s["size"] - F.greatest(acc["end"], s["first"]), F.lit(0))).alias("n")),
        lambda acc: acc["n"],
    )

    def counts() -> Callable[[list], dict]:
        return lambda texts: {"n_words": Words(texts, ALPHANUMERIC).sizes}

    both = map_texts(rows, counts, "n_words long", "row").join(hits.hint("merge").select("row", covered.alias("hit"), "names"), "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    n_hit = zero(F.col("hit"))
    return both.select(
        "row", "n_words", n_hit.alias("n_hit"), zero(F.size("names")).alias("n_items"), F.sha2(F.coalesce(F.array_join("names", ","), F.lit("")).cast("binary"), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def op3_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP3_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS size, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS words
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM windows),
spans AS (SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS words
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)),
found AS (SELECT doc_id, i, size, item_id FROM spans JOIN windows USING (size, words)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT doc_id, i, size FROM found)) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM found GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""
