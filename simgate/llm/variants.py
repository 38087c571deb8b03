"""Spelling variants, by the full neighbourhood of every word.

For each word of the vocabulary all distinct strings that one deletion, replacement or insertion gives, over the
alphabet that the vocabulary shows, are generated, and those that are words themselves are found by a hash join with
the vocabulary; no distance is worked out. A word's form is its most frequent near word, if that is frequent enough,
and its root is where following forms ends.

A neighbourhood has about 900 strings for a word of eight letters, so the strings are not sent anywhere before most of
them are sorted out. One edit leaves either the first or the last half of a word as it is: words are dealt out by the
half that stays, once for each of the two, and a task generates, for each word of a group, the edits of the other half,
as rolling hashes in numpy. Only strings whose hash is that of a word of the same group are written out as text and
joined with the vocabulary, which decides. A group are the words of almost one length that share one half; a task holds
one group, or several small ones, at a time.

Defined results: a null or empty text has no words; a null id counts as the empty string where occurrences are picked
for a slip; equal counts go to the smallest word in code-point order; repeated rows count each; texts of any length
are read whole; an empty vocabulary gives no rows; other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simgate.llm.pretokens import gather, mix
from simgate.llm.shared import discard, written
from simgate.llm.tables import documents

LEAST_LENGTH, LEAST_COUNT, RATIO = 5, 3, 2
SLIP = 97
WORD = r"[A-Za-zÀ-ÿ]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Words that a task takes on together, where groups are smaller, and strings that it generates at a time.
TOGETHER, AT_ONCE = 60_000, 1_000_000
#: An odd base of the rolling hash, and its inverse.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
DELETE, REPLACE, INSERT = -1, 0, 1


def vocabulary(df: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, slip: int = SLIP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word and n, the occurrences of words in all texts, each with the slip that its id and word give it."""
    text = F.translate(df[text_col].cast("string"), UPPER, UPPER.lower())
    runs = df.select(F.coalesce(df[id_col].cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).alias("run"))
    h = F.crc32(F.concat_ws(":", "id", "run").cast("binary"))
    at = (h % F.length("run")).cast("int")
    slipped = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    words = runs.select(F.when(h % slip == 0, slipped).otherwise(F.col("run")).alias("word")).where(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


class Group:
    """Words (Latin-1 bytes) of groups, with rolling hashes of their beginnings."""

    def __init__(self, words: list[str], group: np.ndarray):
        self.data = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
        self.sizes = np.array([len(w) for w in words], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.group = group.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        self.longest = int(self.sizes.max())
        self.up = np.array([pow(BASE, i, 1 << 64) for i in range(self.longest + 2)], np.uint64)
        place = np.arange(len(self.data)) - np.repeat(self.starts, self.sizes)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * self.up[place])))
        self.sums = sums  # differences of these, modulo 2**64, hash any stretch of a word
        keys = self.keys(np.arange(len(words)), self.before(np.arange(len(words)), self.sizes), self.sizes)
        self.found = np.unique(keys)
        self.bits = max(12, int(len(words) * 48).bit_length())
        self.maybe = np.zeros(1 << self.bits, bool)
        self.maybe[keys >> np.uint64(64 - self.bits)] = True

    def before(self, word: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """Hash of the first ``upto`` letters."""
        at = self.starts[word]
        return self.sums[at + upto] - self.sums[at]

    def keys(self, word: np.ndarray, hashes: np.ndarray, size: np.ndarray) -> np.ndarray:
        return mix(hashes + self.group[word] + size.astype(np.uint64) * np.uint64(0x94D049BB133111EB))

    def known(self, keys: np.ndarray) -> np.ndarray:
        """Places of the keys that some word of their group has."""
        at = np.flatnonzero(self.maybe[keys >> np.uint64(64 - self.bits)])
        near = np.minimum(np.searchsorted(self.found, keys[at]), len(self.found) - 1)
        return at[self.found[near] == keys[at]]

    def edits(self, kind: int, word: np.ndarray, place: np.ndarray, alphabet: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which of the words, edited at a place, may be words: word, place and letter. Each distinct string is made once."""
        size, at = self.sizes[word], self.starts[word] + place
        if kind == DELETE:  # of equal neighbours the last goes
            own = np.flatnonzero((place + 1 == size) | (self.data[at] != self.data[np.minimum(at + 1, len(self.data) - 1)]))
            word, place, size = word[own], place[own], size[own]
            first = self.before(word, place)
            rest = self.before(word, size) - self.before(word, place + 1)
            hit = self.known(self.keys(word, first + rest * np.uint64(INVERSE), size - 1))
            return word[hit], place[hit], np.zeros(len(hit), np.uint8)
        first, whole = self.before(word, place), self.before(word, size)
        if kind == REPLACE:
            rest = whole - self.before(word, place + 1)
        else:
            rest = (whole - first) * np.uint64(BASE)
        here = np.where(place < size, self.data[np.minimum(at, len(self.data) - 1)], 0)  # a letter goes in behind its like, and in place of another
        hashes = (first + rest)[:, None] + (alphabet.astype(np.uint64) + np.uint64(1)) * self.up[place][:, None]
        constant = self.group[word] + (size + kind).astype(np.uint64) * np.uint64(0x94D049BB133111EB)
        hit = self.known(mix(hashes + constant[:, None]).ravel())
        row, letter = hit // len(alphabet), alphabet[hit % len(alphabet)]
        other = letter != here[row]
        return word[row[other]], place[row[other]], letter[other]

    def texts(self, kind: int, word: np.ndarray, place: np.ndarray, letter: np.ndarray) -> list[str]:
        """The edited words."""
        if not len(word):
            return []
        size = self.sizes[word] + kind + 1  # and a line end
        upto = np.cumsum(size)
        own = np.arange(int(upto[-1])) - np.repeat(upto - size, size)
        at = np.repeat(place, size)
        source = own - kind * (own > at) if kind == INSERT else own + (own >= at) * (kind == DELETE)
        out = self.data[np.minimum(np.repeat(self.starts[word], size) + source, len(self.data) - 1)]
        if kind != DELETE:
            out[upto - size + place] = letter
        out[upto - 1] = 10
        return out.tobytes().decode("latin-1").split("\n")[:-1]


def _wanted(kind: int, sizes: np.ndarray, half: np.ndarray) -> np.ndarray:
    """Whether words of a group by halves of ``half`` letters have edits of this kind there: the shorter of two words sets the half."""
    least = half * 2 + (1 if kind == DELETE else 0)
    return (sizes >= least) & (sizes <= half * 2 + (2 if kind == DELETE else 1))


def near_in(group: Group, half: np.ndarray, head: np.ndarray, alphabet: np.ndarray) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Numbers of words, and for each a string of its neighbourhood that may be a word."""
    for kind in (DELETE, REPLACE, INSERT):
        member = np.flatnonzero(_wanted(kind, group.sizes, half))
        if not len(member):
            continue
        # the first half stays: edits from there on; the last half stays: edits before its mirror image
        low = np.where(head[member], half[member], 0)
        high = np.where(head[member], group.sizes[member] + (kind == INSERT), half[member])
        n = high - low
        step = max(1, AT_ONCE // (len(alphabet) if kind != DELETE else 1) // int(n.max()))
        for k in range(0, len(member), step):
            m, c = member[k : k + step], n[k : k + step]
            word = np.repeat(m, c)
            place = np.arange(len(word)) - np.repeat(np.cumsum(c) - c, c) + np.repeat(low[k : k + step], c)
            found = group.edits(kind, word, place, alphabet)
            yield found[0], group.texts(kind, *found)


def neighbours(words: DataFrame, alphabet: np.ndarray, parts: int) -> DataFrame:
    """(word, near) strings of neighbourhoods that may be words; words go with the half that stays."""
    size, half = F.length("word"), F.expr("int(length(word) div 2)")
    halves = F.explode(F.when(size % 2 == 0, F.array(half, half - 1)).otherwise(F.array(half)))  # a word is the longer of a pair in the half before
    sided = words.select("word", halves.alias("half")).select("word", "half", F.explode(F.array(F.lit(True), F.lit(False))).alias("head"))
    kept = F.when(F.col("head"), F.expr("left(word, half)")).otherwise(F.expr("right(word, half)"))
    dealt = sided.withColumn("kept", kept).repartition(parts, "half", "head", "kept").sortWithinPartitions("half", "head", "kept")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches):
            if not len(table):
                continue
            half, head = table.column("half").to_numpy(), table.column("head").to_numpy(zero_copy_only=False)
            change = table.column("kept").to_pylist()
            number = np.cumsum([0] + [a != b for a, b in zip(change[1:], change[:-1], strict=True)])
            number = number * 2 + head + (half.astype(np.int64) << 40)
            words = table.column("word").to_pylist()
            for own, texts in near_in(Group(words, number), half.astype(np.int64), head, alphabet):
                yield pa.RecordBatch.from_arrays([pa.array([words[i] for i in own.tolist()], pa.string()), pa.array(texts, pa.string())], names=["word", "near"])

    return dealt.mapInArrow(run, "word string, near string")


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole groups (rows with one ``half``, ``head`` and ``kept``, which follow one another), of TOGETHER rows or one group more."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        held.append(batch)
        count += len(batch)
        if count < TOGETHER:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        same = [pc.equal(table.column(c), table.column(c)[-1]) for c in ("kept", "head", "half")]
        cut = len(table) - pc.sum(pc.and_(pc.and_(*same[:2]), same[2])).as_py()  # sorted: what equals the last row stands at the end
        if cut:
            yield table.slice(0, cut).combine_chunks()
        held, count = table.slice(cut).combine_chunks().to_batches(), len(table) - cut
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def rooted(forms: DataFrame) -> DataFrame:
    """word and root, where following (word, form) ends; a path of n steps takes about log n rounds."""
    ahead = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = ahead.select(F.col("word").alias("root"), F.col("root").alias("further"))
        further = written(ahead.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        discard(ahead)
        ahead = further.select("word", "root")
        ahead.written_to = further.written_to
        if further.where("moved").isEmpty():
            return ahead


def variants(df: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, ratio: int = RATIO, slip: int = SLIP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of the vocabulary."""
    words = written(vocabulary(df, least_length, least_count, slip, id_col, text_col), "vocabulary")
    letters = words.select(F.explode(F.split("word", "")).alias("c")).where("c <> ''").distinct().collect()  # of the 90 that words can have
    alphabet = np.array(sorted(ord(r["c"]) for r in letters), np.uint8)
    parts = 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    candidates = neighbours(words, alphabet, parts)
    counted = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    links = candidates.join(counted.hint("shuffle_hash"), "near")
    best = links.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    near = written(best.select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n")), "nearest")
    large = F.col("near_n") >= ratio * F.col("n")
    found = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(large, F.col("near")).alias("form"), F.when(large, F.col("near_n")).alias("form_n"))
    found = written(found, "forms")
    roots = rooted(found.where("form IS NOT NULL"))
    discard(words, near)
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(documents(spark, sf_dir))
