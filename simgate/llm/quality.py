"""Quality scores by attention-based multiple-instance learning (Ilse et al., 2018).

A text is a bag of passages of 400 characters. Every passage is encoded from what its characters
are (shares of character kinds, of pairs of kinds, of repeated words), a gated attention
network weighs the passages, and the weighted passage representation is scored. All weights are
learned together from labels of documents alone, by gradient descent in numpy on a sample of labelled
documents: about ``SAMPLE_ROWS`` at most, and so few that they hold about ``SAMPLE_PASSAGES`` passages
in all. A hash of the id chooses them, whatever their length. Each is learned from whole, but one of more than
``BAG_PASSAGES`` passages (800,000 characters) from so many of them, evenly spaced over all of the text, so that no
single text decides the size of the sample; every document is scored, over all of its passages.

Defined results: a null or empty text is one empty passage and gets a score like any other; a
null id stays null, is not held out and not learned from; of several labels of one document the
least counts; without labels, or with one kind only, every score is the share of label 1 (0.5
without any); repeated rows give repeated rows; texts of any length are read whole; other columns
are dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simgate.llm.language import held_out
from simgate.llm.pretokens import LETTER, NUMBER, classes, joined, span_hashes
from simgate.llm.shared import discard, written
from simgate.llm.tables import byte_slices, documents, map_texts, table

PASSAGE = 400
#: Characters of a text that are looked at together: whole passages.
PART = 4_000 * PASSAGE
SAMPLE_ROWS, SAMPLE_PASSAGES, BAG_PASSAGES = 6_000, 200_000, 2_000
HIDDEN, ATTENTION, EPOCHS, BATCH, RATE, DECAY = 24, 12, 40, 64, 0.01, 1e-4
#: Kinds of characters: each ASCII mark for itself, then the rest.
MARKS = 33
UPPER, LOWER, OTHER_LETTER, DIGIT, BLANK, LINE, OTHER = range(MARKS, MARKS + 7)
KINDS = MARKS + 7
COARSE = 6
FEATURES = KINDS + COARSE * COARSE + 4


def _kinds() -> tuple[np.ndarray, np.ndarray]:
    """Fine and coarse kind of each code point."""
    base = classes()
    fine = np.full(len(base), OTHER, np.uint8)
    fine[base == LETTER] = OTHER_LETTER
    fine[base == NUMBER] = DIGIT
    fine[ord("A") : ord("Z") + 1], fine[ord("a") : ord("z") + 1] = UPPER, LOWER
    fine[32], fine[10] = BLANK, LINE
    marks = [c for c in range(33, 128) if fine[c] == OTHER]
    fine[marks] = np.arange(len(marks))
    coarse = np.select([fine == UPPER, (fine == LOWER) | (fine == OTHER_LETTER), fine == DIGIT, fine == BLANK, fine == LINE], [0, 1, 2, 3, 4], 5).astype(np.uint8)
    return fine, coarse


_tables: list = []


def passages(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Features (passages, FEATURES) of all passages, and where each text's begin, with the end.

    A long text is taken in parts of ``PART`` characters, whole passages each, as passages don't depend on one another.
    """
    if all(len(t or "") <= PART for t in texts):
        return _passages(texts)
    made, counts = [], []
    for text in texts:
        parts = [_passages([(text or "")[k : k + PART]])[0] for k in range(0, max(len(text or ""), 1), PART)]
        made += parts
        counts.append(sum(map(len, parts)))
    return np.concatenate(made), np.concatenate(([0], np.cumsum(counts)))


def _passages(texts: list) -> tuple[np.ndarray, np.ndarray]:
    if not _tables:
        _tables.append(_kinds())
    fine_of, coarse_of = _tables[0]
    text, points, bounds = joined(texts)
    sizes = np.diff(bounds)
    n_of = np.maximum(-(-sizes // PASSAGE), 1)
    first = np.concatenate(([0], np.cumsum(n_of)))
    n = int(first[-1])
    owner = np.repeat(np.arange(len(texts)), sizes)
    place = first[owner] + (np.arange(len(points)) - bounds[owner]) // PASSAGE
    fine, coarse = fine_of[points].astype(np.int64), coarse_of[points].astype(np.int64)
    total = np.maximum(np.bincount(place, minlength=n), 1)[:, None]
    kinds = np.bincount(place * KINDS + fine, minlength=n * KINDS).reshape(n, KINDS) / total
    same = place[1:] == place[:-1]
    pairs = (place[1:] * COARSE + coarse[:-1]) * COARSE + coarse[1:]
    pairs = np.bincount(pairs[same], minlength=n * COARSE * COARSE).reshape(n, -1) / total
    # words: how many, how long, how many stand twice in their passage or just before
    blank = (coarse == 3) | (coarse == 4)
    edge = np.ones(len(points), bool)
    edge[1:] = ~same
    starts = np.flatnonzero(~blank & (edge | np.concatenate(([True], blank[:-1]))))
    stop = np.append(edge[1:], True) | np.append(blank[1:], True)
    ends = np.flatnonzero(~blank & stop) + 1
    words = np.zeros((n, 4))
    if len(starts):
        at, h = place[starts], span_hashes(points, starts, ends)
        count = np.maximum(np.bincount(at, minlength=n), 1)
        order = np.lexsort((h, at))
        again = (at[order][1:] == at[order][:-1]) & (h[order][1:] == h[order][:-1])
        next_same = (at[1:] == at[:-1]) & (h[1:] == h[:-1])
        words[:, 0] = np.bincount(at, ends - starts, n) / count / 10
        words[:, 1] = np.bincount(at[order][1:], again, n) / count
        words[:, 2] = np.bincount(at[1:], next_same, n) / count
    words[:, 3] = total[:, 0] / PASSAGE
    return np.sqrt(np.concatenate((kinds, pairs, words), 1)).astype(np.float32), first


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Model:
    """Encoder, gated attention and score; ``forward`` gives probabilities and what gradients need."""

    def __init__(self, share: float = 0.5):
        rng = np.random.default_rng(7)
        draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
        self.w = {
            "encode": draw(FEATURES, HIDDEN), "encode_0": np.zeros(HIDDEN), "tanh": draw(HIDDEN, ATTENTION), "gate": draw(HIDDEN, ATTENTION),
            "weigh": draw(ATTENTION, 1), "score": draw(HIDDEN, 1), "score_0": np.zeros(1),
        }
        self.mean, self.spread = np.zeros(FEATURES), np.ones(FEATURES)
        self.share, self.learned = share, False

    def forward(self, x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, tuple]:
        w, own = self.w, np.repeat(np.arange(len(first) - 1), np.diff(first))
        x = (x - self.mean) / self.spread
        h = np.tanh(x @ w["encode"] + w["encode_0"])
        t, g = np.tanh(h @ w["tanh"]), _sigmoid(h @ w["gate"])
        e = ((t * g) @ w["weigh"])[:, 0]
        e = np.exp(e - np.maximum.reduceat(e, first[:-1])[own])
        a = e / np.add.reduceat(e, first[:-1])[own]
        z = np.add.reduceat(a[:, None] * h, first[:-1])
        return _sigmoid((z @ w["score"] + w["score_0"])[:, 0]), (x, own, h, t, g, a, z)

    def gradients(self, p: np.ndarray, y: np.ndarray, weight: np.ndarray, kept: tuple) -> dict:
        x, own, h, t, g, a, z = kept
        w, d = self.w, ((p - y) * weight / len(y))[:, None]
        dz = (d @ w["score"].T)[own]
        da = (dz * h).sum(1)
        de = a * (da - np.bincount(own, a * da)[own])
        dtg = de[:, None] * w["weigh"][:, 0]
        dt, dg = dtg * g * (1 - t * t), dtg * t * g * (1 - g)
        dh = a[:, None] * dz + dt @ w["tanh"].T + dg @ w["gate"].T
        du = dh * (1 - h * h)
        return {
            "encode": x.T @ du, "encode_0": du.sum(0), "tanh": h.T @ dt, "gate": h.T @ dg, "weigh": (t * g).T @ de[:, None],
            "score": z.T @ d, "score_0": d.sum(0),
        }

    def learn(self, bags: list[np.ndarray], y: np.ndarray) -> Model:
        rng = np.random.default_rng(11)
        everything = np.concatenate(bags)  # SAMPLE_PASSAGES rows of FEATURES floats, about
        self.mean, self.spread = everything.mean(0), everything.std(0) + 0.02
        weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
        m, v, step = {k: 0 * w for k, w in self.w.items()}, {k: 0 * w for k, w in self.w.items()}, 0
        for epoch in range(EPOCHS):
            order = rng.permutation(len(bags))
            for k in range(0, len(order), BATCH):
                own = order[k : k + BATCH]
                first = np.concatenate(([0], np.cumsum([len(bags[i]) for i in own])))
                p, kept = self.forward(np.concatenate([bags[i] for i in own]), first)
                step += 1
                rate = RATE * (1 - epoch / EPOCHS)
                for name, grad in self.gradients(p, y[own], weight[own], kept).items():
                    grad = grad + DECAY * self.w[name]
                    m[name] = 0.9 * m[name] + 0.1 * grad
                    v[name] = 0.999 * v[name] + 0.001 * grad * grad
                    self.w[name] = self.w[name] - rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.999**step)) + 1e-8)
        self.learned = True
        return self

    def judge(self, texts: list) -> dict:
        if not self.learned:
            scores = np.full(len(texts), self.share)
        else:
            scores, _ = self.forward(*passages(texts))
        return {"score": scores, "predicted": (scores >= 0.5).astype(np.int32)}


def spread(rows: np.ndarray, most: int) -> np.ndarray:
    """All of the rows, or ``most`` of them, evenly spaced."""
    return rows if len(rows) <= most else rows[np.arange(most) * len(rows) // most]


def fit(df: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_passages: int = SAMPLE_PASSAGES, bag_passages: int = BAG_PASSAGES, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """A model from the labelled rows of df."""
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).dropna().groupBy("id").agg(F.min("y").alias("y"))
    place, whole = F.pmod(F.xxhash64("id"), F.lit(1 << 20)), 1 << 20
    share = min(1.0, sample_rows / max(known.count(), 1))
    picked = known.where(place < int(share * whole))  # about sample_rows rows
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(picked), "id")
    rows = labelled = written(rows.select("id", "y", "text"), "labelled")
    own = F.least(F.greatest(F.ceil(F.coalesce(F.length("text"), F.lit(0)) / PASSAGE), F.lit(1)), F.lit(bag_passages))
    held = rows.agg(F.sum(own)).first()[0] or 0
    if held > sample_passages:
        rows = rows.where(place < int(share * sample_passages / held * whole))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in byte_slices(batch.column(2)):
                x, first = passages(batch.column(2).slice(a, b - a).to_pylist())
                bags = [spread(x[i:j], bag_passages).tobytes() for i, j in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(bags, pa.binary())], names=["id", "y", "bag"])

    sample = sorted((r["id"], r["y"], bytes(r["bag"])) for r in rows.mapInArrow(run, "id long, y int, bag binary").collect())
    discard(labelled)
    y = np.array([s[1] for s in sample], np.float64)
    if not len(y) or y.min() == y.max():
        return Model(float(y.mean()) if len(y) else 0.5)
    return Model(float(y.mean())).learn([np.frombuffer(s[2], np.float32).reshape(-1, FEATURES) for s in sample], y)


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(model)
    make: Callable = lambda: shared.value.judge
    return map_texts(df, make, "score double, predicted int", id_col, text_col)


def op8_mil_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs.where(~held_out("doc_id", 3, 1)), table(spark, sf_dir, "labels"))
    found = score(docs, model)
    return found.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", "predicted")
