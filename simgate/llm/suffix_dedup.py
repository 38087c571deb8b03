"""Removal of repeated passages by a distributed merge sort of suffixes.

A byte goes if a string of 200 bytes that covers it also starts anywhere else. Windows of 200 bytes
are judged at their anchors (see ``suffixes``), by the tight context: the bytes of all windows that
have that anchor. Steps, each a Spark job over tables in the shared folder:

1. Anchors by gram. Grams that stand once are done: nothing there repeats.
2. Of equal contexts (gram and context have a 64-bit hash each) two go on, the first and the last;
   what lies between them repeats wholly. So a passage of many copies moves twice, not each time.
3. Contexts are sorted, each run in its task. Runs are front-coded (only what a suffix does not
   share with the one before it is sent), cut at the splitters, and exchanged by range, forwards and
   backwards from the anchor.
4. Each range's runs are merged by a tree of losers that never compares known prefixes again. What
   a suffix shares with its neighbours in both orders gives windows that certainly repeat and bounds
   of those that may; neighbours across ranges are compared too.
5. Windows between the two (a context shares its left side with one and its right side with
   another) are looked up as strings (a digest of 128 bits), for their grams alone.

The driver holds the splitters: about four sampled contexts a range of RANGE suffixes.

Defined results: a null text is empty; a text under 200 bytes keeps all its bytes; repeated rows
are different documents, so both lose what they share; a null id stays null; rows of one id with
different texts are judged each by its own; other columns are dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from simgate.llm import suffixes as sx
from simgate.llm.shared import discard, written
from simgate.llm.tables import documents

#: Suffixes of one sorted run, and of one range of the merge.
RUN, RANGE = 20_000, 40_000
#: Sampled contexts for each range, and the least of them in all.
SAMPLES, SAMPLE = 4, 4_000
#: Rows that are Python objects at a time, and rows of one output batch.
ROWS, BATCH = 100, 500
KEY = ["id", "c"]
NEIGHBOUR = {
    "id": "long", "c": "long", "k": "int", "gram": "long", "right": "int", "left": "int", "forward": "boolean", "up": "int",
    "lo": "int", "hi": "int", "lo2": "int", "hi2": "int", "edge": "boolean", "range": "int", "blob": "binary",
}
RESULT = ", ".join(f"{k} {v}" for k, v in NEIGHBOUR.items())
ARROW = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "string": pa.string(), "longs": pa.list_(pa.int64())}
ARROW_RESULT = pa.schema([(k, ARROW[v]) for k, v in NEIGHBOUR.items()])


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows by id and a hash of the text; of a null id another hash of the text stands in."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = df.select(F.col(id_col).cast("long").alias("name"), text.alias("raw"))
    return rows.select("name", F.coalesce("name", F.xxhash64("raw")).alias("id"), F.xxhash64("raw", F.lit(1)).alias("c"), "raw")


def each(fn: Callable) -> Callable:
    """A mapInArrow function from one of rows (tuples); few rows are Python objects at a time."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                yield from zip(*(c.to_pylist() for c in batch.slice(k, ROWS).columns), strict=True)

    return lambda batches: fn(rows(batches))


def batched(rows: Iterator[tuple], types: dict, most: int = BATCH, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of rows, of bounded length and size (of the last column's values)."""
    held, size = [], 0

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, ARROW[t]) for c, t in zip(zip(*held, strict=True), types.values(), strict=True)], names=list(types))

    for row in rows:
        held.append(row)
        size += len(row[-1]) if isinstance(row[-1], bytes | np.ndarray) else 0
        if len(held) == most or size > most_bytes:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()


def groups(rows: Iterator[tuple], packed: bool) -> Iterator[list[tuple]]:
    """Rows (id, hash, text, more) of about a piece of text together, each with its text and anchors."""
    held, raws, size = [], [], 0
    for row in rows:
        raw = zstandard.decompress(row[2]) if packed else row[2]
        if held and size + len(raw) > sx.PIECE:
            yield list(zip(held, raws, sx.anchors_of(raws), strict=True))
            held, raws, size = [], [], 0
        held.append(row)
        raws.append(raw)
        size += len(raw)
    if held:
        yield list(zip(held, raws, sx.anchors_of(raws), strict=True))


def _anchor_rows(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    def made() -> Iterator[tuple]:
        for group in groups(rows, False):
            tight = sx.tight_hashes([raw for _, raw, _ in group], [a for _, _, a in group])
            yield from ((row[0], row[1], a[1], t) for (row, _, a), t in zip(group, tight, strict=True))

    return batched(made(), {"id": "long", "c": "long", "gram": "longs", "tight": "longs"}, most_bytes=1 << 20)


def _packed(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    return batched(((name, c, zstandard.compress(raw, 1)) for name, c, raw in rows), {"id": "long", "c": "long", "z": "binary"})


def chosen_contexts(rows: Iterator[tuple]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Contexts and tails of the anchors of candidate documents that are to be sorted."""
    for group in groups(rows, True):
        for (name, c, _, marks), raw, (at, gram, lo, hi) in group:
            marks = np.array(sorted(marks), np.int64)
            k = marks[marks & 1 == 1] >> 1
            at, gram, lo, hi = at[k], gram[k], lo[k], hi[k]
            tails = np.zeros(len(k), sx.TAIL)
            tails["id"], tails["c"], tails["k"], tails["gram"], tails["right"], tails["left"] = name, c, k, gram, hi + sx.LENGTH - at, at - lo
            for i in range(0, len(k), RUN):
                own = tails[i : i + RUN]
                yield sx.contexts(raw, at[i : i + RUN], own["right"].astype(np.int64), own["left"].astype(np.int64)), own


def gathered(rows: Iterator[tuple]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Contexts and tails of about RUN suffixes at a time."""
    held, n = [], 0
    for own in chosen_contexts(rows):
        held.append(own)
        n += len(own[0])
        if n >= RUN:
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
            held, n = [], 0
    if n:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def _segments(forward: np.ndarray, backward: np.ndarray) -> Callable:
    """Sort each run in both orders, cut it at the splitters, and pack the segments."""

    def fn(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        for contexts, tails in gathered(rows):
            ranges, blobs = [], []
            for base, splitters, keys in ((0, forward, contexts), (len(forward) + 1, backward, sx.backward(contexts))):
                order = sx.order_of(keys)
                keys, own = keys[order], tails[order]
                cuts = [0, *np.searchsorted(keys.view(f"S{sx.WIDTH}").ravel(), splitters).tolist(), len(keys)]
                for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    if b > a:
                        ranges.append(base + i)
                        blobs.append(sx.pack(keys[a:b], own[a:b]))
            yield pa.RecordBatch.from_arrays([pa.array(ranges, pa.int32()), pa.array(blobs, pa.binary())], names=["range", "blob"])

    return fn


def shares(keys: np.ndarray, tails: np.ndarray, known: np.ndarray | None, forward: bool) -> tuple[np.ndarray, np.ndarray]:
    """What neighbours in order share after and before the anchor, within both contexts."""
    first = sx.LENGTH if forward else sx.LEFT
    front = np.minimum(known, first) if known is not None else sx.common(keys[1:, :first], keys[:-1, :first])
    rest = sx.common(keys[1:, first:], keys[:-1, first:])
    right, left = (front, rest) if forward else (rest, front)
    least = lambda name: np.minimum(tails[name][1:], tails[name][:-1]).astype(np.int64)
    return np.minimum(right, least("right")), np.minimum(left, least("left"))


def _judged(tails: np.ndarray, right: np.ndarray, left: np.ndarray, forward: bool) -> pd.DataFrame:
    """A row for each suffix: the windows that each of its two neighbours has too, and the bound of its side."""
    hit, up = right + left >= sx.LENGTH, right if forward else left
    lo, hi = np.where(hit, sx.LENGTH - right, 1), np.where(hit, left, 0)
    before = lambda x, none: np.concatenate(([none], x))
    after = lambda x, none: np.concatenate((x, [none]))
    return pd.DataFrame({
        **{n: tails[n] for n in ("id", "c", "k", "gram", "right", "left")}, "forward": forward, "up": np.maximum(before(up, 0), after(up, 0)),
        "lo": before(lo, 1), "hi": before(hi, 0), "lo2": after(lo, 1), "hi2": after(hi, 0), "edge": False, "range": 0, "blob": None,
    })


def _merge(ranges: int) -> Callable:
    def fn(group: pd.DataFrame) -> pd.DataFrame:
        number = int(group["range"].iloc[0])
        forward = number < ranges
        runs = [sx.Run(b) for b in group["blob"]]
        n = sum(r.n for r in runs)
        keys, tails, known = np.empty((n, sx.WIDTH), np.uint8), np.empty(n, sx.TAIL), np.empty(n, np.int64)
        for at, (r, i, shared) in enumerate(sx.merged(runs)):
            keys[at] = np.frombuffer(runs[r].key, np.uint8)
            tails[at], known[at] = runs[r].tails[i], shared
        parts = [shares(keys[k : k + RUN + 1], tails[k : k + RUN + 1], known[k + 1 : k + RUN + 1], forward) for k in range(0, max(n - 1, 1), RUN)]
        out = _judged(tails, *(np.concatenate(x) for x in zip(*parts, strict=True)), forward)
        ends = [0, n - 1]
        edge = {c: [0] for c in NEIGHBOUR} | {"forward": [forward], "lo": [1], "lo2": [1], "edge": [True], "range": [number], "blob": [sx.pack(keys[ends], tails[ends])]}
        return pd.concat([out, pd.DataFrame(edge)])

    return fn


def _edges(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Judge the last suffix of a range with the first of the next."""
    for forward, a, b in rows:
        one, two = sx.Run(a), sx.Run(b)
        one.next()
        one.next()
        two.next()
        keys = np.frombuffer(one.key + two.key, np.uint8).reshape(2, sx.WIDTH)
        tails = np.concatenate((one.tails[1:], two.tails[:1]))
        yield pa.RecordBatch.from_pandas(_judged(tails, *shares(keys, tails, None, forward), forward), schema=ARROW_RESULT, preserve_index=False)


def uncovered(lo: int, hi: int, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The parts of lo..hi that no span covers."""
    out = []
    for a, b in sorted(spans):
        if a > lo:
            out.append((lo, min(a - 1, hi)))
        lo = max(lo, b + 1)
        if lo > hi:
            break
    if lo <= hi:
        out.append((lo, hi))
    return out


#: Distances of windows before their anchor (up to LEFT) are sets of bits, in so many longs.
BITS = ("b0", "b1", "b2")


def to_longs(bits: int) -> tuple[int, ...]:
    words = (bits >> 64 * i & (1 << 64) - 1 for i in range(len(BITS)))
    return tuple(w - (w >> 63 << 64) for w in words)


def from_longs(*longs: int) -> int:
    return sum((w & (1 << 64) - 1) << 64 * i for i, w in enumerate(longs))


def from_to(lo: int, hi: int) -> int:
    """The bits lo to hi."""
    return (1 << hi + 1) - (1 << lo) if lo <= hi else 0


def _open(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """The windows (by distance before the anchor) that may repeat and are not known to."""

    def made() -> Iterator[tuple]:
        for name, c, k, gram, right, left, spans in rows:
            if right + left >= sx.LENGTH:
                bits = sum(from_to(a, b) for a, b in uncovered(sx.LENGTH - right, left, [(s["lo"], s["hi"]) for s in spans if s["lo"] <= s["hi"]]))
                if bits:
                    yield name, c, k, gram, *to_longs(bits)

    return batched(made(), {"id": "long", "c": "long", "k": "int", "gram": "long"} | dict.fromkeys(BITS, "long"), 5_000)


def _windows(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Digests of a document's windows that are in question at their gram, as far as each can repeat, and whether this very one is asked for."""

    def made() -> Iterator[tuple]:
        for group in groups(rows, True):
            for (name, c, _, wanted), raw, (at, _, lo, hi) in group:
                asked = {w["k"]: from_longs(*(w[b] for b in BITS)) for w in wanted if w["own"]}
                for w in wanted:
                    k = w["k"]
                    if w["own"]:
                        continue
                    bits = from_longs(*(w[b] for b in BITS)) & from_to(max(sx.LENGTH - w["right"], 0), w["left"])
                    for o in range(int(at[k] - hi[k]), int(at[k] - lo[k]) + 1):
                        if bits >> o & 1:
                            start = int(at[k]) - o
                            yield name, c, k, o, bool(asked.get(k, 0) >> o & 1), hashlib.blake2b(raw[start : start + sx.LENGTH], digest_size=16).digest()

    return batched(made(), {"id": "long", "c": "long", "k": "int", "o": "int", "asked": "boolean", "window": "binary"}, 5_000)


def _kept(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Removed bytes, spans and the digest of the rest, for candidate documents."""

    def made() -> Iterator[tuple]:
        for group in groups(rows, True):
            for (name, c, _, marks, spans), raw, (at, _, lo, hi) in group:
                between = np.array([m >> 1 for m in marks if not m & 1], np.int64)  # two equal ones
                k = np.array([j["k"] for j in spans or ()], np.int64)
                first = np.array([j["hi"] for j in spans or ()], np.int64)
                last = np.array([j["lo"] for j in spans or ()], np.int64)
                starts, ends = np.concatenate((lo[between], at[k] - first)), np.concatenate((hi[between], at[k] - last)) + sx.LENGTH
                n = len(raw) + 1
                gone = np.cumsum(np.bincount(starts, minlength=n) - np.bincount(ends, minlength=n))[:-1] > 0
                rest = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                yield name, c, int(gone.sum()), runs, hashlib.sha256(rest).hexdigest(), rest

    return batched(made(), {"id": "long", "c": "long", "n_removed": "long", "n_spans": "long", "kept_sha256": "string", "kept": "binary"}, 200)


def splitters_of(candidates: DataFrame, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys at which ranges begin, in both orders, from a sample of contexts."""
    ranges = total // RANGE + 1
    found = []
    if ranges > 1:
        share = max(1, total // max(SAMPLE, SAMPLES * ranges))
        picked = F.filter("marks", lambda m: (m % 2 == 1) & (F.pmod(F.xxhash64("id", "c", m), F.lit(share)) == 0))  # only where ranges begin depends on it
        some = candidates.withColumn("marks", picked).where(F.size("marks") > 0).select("id", "c", "z", "marks")

        def sampled(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
            return batched(((x.tobytes(),) for own in chosen_contexts(rows) for x in own[0]), {"f": "binary"})

        found = [bytes(r[0]) for r in some.mapInArrow(each(sampled), "f binary").collect()]
    contexts = np.frombuffer(b"".join(found), np.uint8).reshape(-1, sx.WIDTH)
    out = []
    for keys in (contexts, sx.backward(contexts)):
        ordered = np.unique(np.ascontiguousarray(keys).view(f"S{sx.WIDTH}").ravel())
        out.append(np.unique(ordered[[len(ordered) * j // ranges for j in range(1, ranges)]] if len(ordered) else ordered))
    n = min(map(len, out))
    return out[0][:n], out[1][:n]


def repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """name (the id), n_bytes, n_removed, n_spans, kept_sha256 and kept (null: all bytes) of every row."""
    docs = keyed(df, id_col, text_col)
    long_enough = docs.where(F.octet_length("raw") >= sx.LENGTH).select("id", "c", "raw")
    marks = written(long_enough.mapInArrow(each(_anchor_rows), "id long, c long, gram array<long>, tight array<long>"), "anchors")
    grams = marks.select(F.explode("gram").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram")
    grams = written(grams, "grams")  # a table, so that the join can split common grams
    places = marks.select("id", "c", F.posexplode(F.arrays_zip("gram", "tight")).alias("k", "x")).select("id", "c", "k", "x.gram", "x.tight")
    places = written(places.join(grams.hint("merge"), "gram"), "places")
    own = F.struct("id", "c", "k")
    classes = places.groupBy("gram", "tight").agg(F.count(F.lit(1)).alias("n"), F.min(own).alias("low"), F.max(own).alias("high"))
    classes = written(classes, "classes")  # as grams
    goes = (F.col("n") == 1) | (F.col("low") != F.col("high")) & ((own == F.col("low")) | (own == F.col("high")))
    held = places.join(classes.hint("merge"), ["gram", "tight"]).groupBy(*KEY).agg(F.collect_set(F.col("k").cast("long") * 2 + goes.cast("int")).alias("marks"))
    packed = long_enough.mapInArrow(each(_packed), "id long, c long, z binary").groupBy(*KEY).agg(F.first("z").alias("z"))
    candidates = written(packed.join(held.hint("merge"), KEY).select("id", "c", "z", "marks"), "candidates")
    total = candidates.agg(F.sum(F.size(F.filter("marks", lambda m: m % 2 == 1)))).first()[0] or 0

    discard(marks, grams, places, classes)
    judged, used = None, [candidates]
    if total:
        forward, backward = splitters_of(candidates, total)
        sorting = candidates.where(F.exists("marks", lambda m: m % 2 == 1))
        runs = sorting.mapInArrow(each(_segments(forward, backward)), "range int, blob binary")
        merged = written(runs.groupBy("range").applyInPandas(_merge(len(forward) + 1), RESULT), "merged")
        ends = merged.where("edge").select("forward", "range", "blob")
        following = ends.withColumn("next", F.lead("blob").over(Window.partitionBy("forward").orderBy("range"))).where("next IS NOT NULL")  # a row for each range
        across = following.select("forward", "blob", "next").mapInArrow(each(_edges), RESULT)
        rows = merged.where("NOT edge").union(across)
        span = lambda a, b: F.struct(F.col(a).alias("lo"), F.col(b).alias("hi"))
        rows = rows.groupBy("id", "c", "k", "gram").agg(
            F.max(F.when(F.col("forward"), F.col("up")).otherwise(0)).alias("right"), F.max(F.when(F.col("forward"), 0).otherwise(F.col("up"))).alias("left"),
            F.array_distinct(F.flatten(F.collect_list(F.filter(F.array(span("lo", "hi"), span("lo2", "hi2")), lambda s: s["lo"] <= s["hi"])))).alias("spans"),
        )
        rows = written(rows, "neighbours")
        discard(merged)
        open_ = written(rows.select("id", "c", "k", "gram", "right", "left", "spans").mapInArrow(each(_open), "id long, c long, k int, gram long, b0 long, b1 long, b2 long"), "open")
        used += [rows, open_]
        judged = rows.select("id", "c", "k", F.explode("spans").alias("s")).select("id", "c", "k", "s.lo", "s.hi")
        if not open_.isEmpty():
            wanted = open_.groupBy("gram").agg(*(F.bit_or(b).alias(b) for b in BITS))
            part = lambda own: F.struct("k", "right", "left", *BITS, F.lit(own).alias("own")).alias("w")
            wanted = written(wanted, "wanted")
            others = rows.select("id", "c", "k", "gram", "right", "left").join(wanted.hint("merge"), "gram").where(F.col("right") + F.col("left") >= sx.LENGTH)
            asked = open_.withColumns({"right": F.lit(0), "left": F.lit(0)})
            codes = others.select("id", "c", part(False)).union(asked.select("id", "c", part(True))).groupBy(*KEY).agg(F.collect_list("w").alias("wanted"))
            looked = written(candidates.select("id", "c", "z").join(codes.hint("merge"), KEY).select("id", "c", "z", "wanted"), "looked")
            windows = written(looked.mapInArrow(each(_windows), "id long, c long, k int, o int, asked boolean, window binary"), "windows")
            discard(wanted, looked)
            used.append(windows)
            twice = windows.groupBy("window").agg(F.count(F.lit(1)).alias("n"), F.bool_or("asked").alias("any")).where("n > 1 AND any").select("window")
            hits = windows.where("asked").join(twice, "window").select("id", "c", "k", F.col("o").alias("lo"), F.col("o").alias("hi"))
            judged = judged.union(hits)
        judged = judged.groupBy(*KEY).agg(F.collect_list(F.struct("k", "lo", "hi")).alias("judged"))
    joined = candidates.join(judged.hint("merge"), KEY, "left") if judged is not None else candidates.withColumn("judged", F.lit(None).cast("array<struct<k:int,lo:int,hi:int>>"))
    found = joined.select("id", "c", "z", "marks", "judged").mapInArrow(each(_kept), "id long, c long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    found = written(found.where("n_removed > 0"), "shortened")
    discard(*used)
    whole = docs.select("name", "id", "c", F.octet_length("raw").cast("long").alias("n_bytes"), F.sha2("raw", 256).alias("whole_sha256"))
    both = whole.join(found, KEY, "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return both.select(F.col("name").alias(id_col), "n_bytes", zero("n_removed"), zero("n_spans"), F.coalesce("kept_sha256", "whole_sha256").alias("kept_sha256"), "kept")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(documents(spark, sf_dir)).drop("kept")
