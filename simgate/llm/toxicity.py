"""Toxicity by non-negative learning from positive and unlabelled texts (Kiryo et al., 2017).

The confirmed toxic documents are the positive sample; the unlabelled sample is drawn from all documents, their
labels unseen. With the class prior p, the risk of a scorer g is ``p E+[l(g)] + max(0, E_u[l(-g)] - p E+[l(-g)])``:
what the unlabelled texts cost as negatives, less the share of it that the positives among them explain. Where that
difference falls below zero the scorer has begun to learn the unlabelled sample by heart, and a step goes against it.
The scorer is linear, in numpy, over the words of a text, their beginnings of three to six letters and their endings
of four (each once a text). Which of these can tell at all is screened by Spark: of those in ``LEAST`` positive texts
or more, the ``FEATURES`` whose shares in the two samples differ by the most standard errors, ``SURE`` at least.

The bounds of the fit: about ``SAMPLE_POSITIVE`` and ``SAMPLE_UNLABELLED`` documents, chosen by a hash of the id and
learned from whole; what reaches the driver are numbers of screened features, ``FEATURES`` a document at most. The
prior is a parameter; without it, the share of toxic documents among all labelled ones of the fit. Every document is
scored, over its whole text.

Defined results: a null or empty text has no features and the score of the intercept; a null id stays null, is not
held out and not learned from; of several labels of one document the least counts; without confirmed toxic documents,
without others, or with a prior of 0 or 1, every score is the prior (0 without labels); repeated rows give repeated
rows; texts of any length are read whole; other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simgate.llm.language import held_out
from simgate.llm.pretokens import LETTER, classes, joined, mix, span_hashes
from simgate.llm.shared import discard, written
from simgate.llm.tables import byte_slices, documents, map_texts, table

SAMPLE_POSITIVE, SAMPLE_UNLABELLED = 4_000, 12_000
FEATURES, LEAST, SURE = 4_096, 6, 5.5
BEGINNINGS, ENDING = (3, 4, 5, 6), 4
STEPS, RATE, DECAY = 300, 0.1, 0.3


def features(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Text number and feature (64-bit hash), each once a text, in order of both."""
    _, points, bounds = joined(["\n" + t.lower() + "\n" if t else "\n" for t in texts])
    letters = np.concatenate(([False], classes()[points] == LETTER))
    flips = np.flatnonzero(letters[1:] != letters[:-1])  # texts end in a line end, so they come in pairs
    starts, ends = flips[::2], flips[1::2]
    owner = np.searchsorted(bounds, starts, "right") - 1
    size = ends - starts
    kinds = [(span_hashes(points, starts, ends), owner)]
    for n in BEGINNINGS:
        long = np.flatnonzero(size > n)
        kinds.append((mix(span_hashes(points, starts[long], starts[long] + n) + np.uint64(n)), owner[long]))
    long = np.flatnonzero(size > ENDING)
    kinds.append((mix(span_hashes(points, ends[long] - ENDING, ends[long]) + np.uint64(99)), owner[long]))
    grams, owner = np.concatenate([k[0] for k in kinds]), np.concatenate([k[1] for k in kinds])
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    first = np.ones(len(grams), bool)
    first[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    return owner[first], grams[first].view(np.int64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Bags:
    """Texts as lists of numbers of features."""

    def __init__(self, bags: list[np.ndarray]):
        self.bags = bags

    def __len__(self) -> int:
        return len(self.bags)

    def entries(self) -> tuple[np.ndarray, np.ndarray]:
        """Number of the text and of the feature of every entry."""
        return np.repeat(np.arange(len(self.bags)), [len(b) for b in self.bags]), np.concatenate([*self.bags, np.zeros(0, np.int32)]).astype(np.int64)


class Model:
    """A linear scorer over screened features."""

    def __init__(self, prior: float = 0.0, known: np.ndarray | None = None):
        self.prior = prior
        self.known = np.zeros(0, np.int64) if known is None else known
        self.w, self.b, self.learned = np.zeros(len(self.known)), 0.0, False

    def find(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """Text number and number of the feature, for the features that are known."""
        owner, grams = features(texts)
        if not len(self.known):
            return owner[:0], grams[:0]
        at = np.minimum(np.searchsorted(self.known, grams), len(self.known) - 1)
        hit = self.known[at] == grams
        return owner[hit], at[hit]

    def margins(self, row: np.ndarray, item: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(row, self.w[item], n) + self.b

    def risk(self, positive: np.ndarray, unlabelled: np.ndarray) -> tuple[float, float]:
        """The positive part of the risk and the (uncorrected) negative part, at margins of both samples."""
        cost = lambda z: np.logaddexp(0, -z).mean()
        return self.prior * cost(positive), cost(-unlabelled) - self.prior * cost(-positive)

    def slopes(self, positive: np.ndarray, unlabelled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How the step's objective changes with each margin: the risk, or less of the negative part where that is below zero."""
        p, u = _sigmoid(positive), _sigmoid(unlabelled)
        gain, own, other = -self.prior * (1 - p) / len(p), -self.prior * p / len(p), u / len(u)
        if self.risk(positive, unlabelled)[1] >= 0:
            return gain + own, other
        return -own, -other

    def learn(self, positive: Bags, unlabelled: Bags) -> Model:
        k = len(self.known)
        self.b = float(np.log(self.prior / (1 - self.prior)))
        m, v = np.zeros(k + 1), np.zeros(k + 1)
        (p_row, p_item), (u_row, u_item) = positive.entries(), unlabelled.entries()
        for step in range(STEPS):  # over both samples whole: small batches fall below zero by chance
            p_slope, u_slope = self.slopes(self.margins(p_row, p_item, len(positive)), self.margins(u_row, u_item, len(unlabelled)))
            grad = np.append(np.bincount(p_item, p_slope[p_row], k) + np.bincount(u_item, u_slope[u_row], k) + DECAY / len(positive) * self.w, p_slope.sum() + u_slope.sum())
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
            move = RATE * (1 - step / STEPS) * (m / (1 - 0.9 ** (step + 1))) / (np.sqrt(v / (1 - 0.999 ** (step + 1))) + 1e-8)
            self.w, self.b = self.w - move[:k], self.b - move[k]
        self.learned = True
        return self

    def judge(self, texts: list) -> dict:
        scores = _sigmoid(self.margins(*self.find(texts), len(texts))) if self.learned else np.full(len(texts), float(self.prior))
        return {"score": scores, "predicted": (scores >= 0.5).astype(np.int32)}


def _sampled(rows: DataFrame, most: int) -> DataFrame:
    """About ``most`` of the rows, by a hash of the id."""
    share = min(1.0, most / max(rows.count(), 1))
    return rows.where(F.pmod(F.xxhash64("id", F.lit("toxicity")), F.lit(1 << 20)) < int(share * (1 << 20)))


def screened(sample: DataFrame, positive: int, unlabelled: int, most: int = FEATURES, least: int = LEAST) -> np.ndarray:
    """The features (sorted) whose shares in the positive and the unlabelled texts of sample (positive int, text) differ most surely."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in byte_slices(batch.column(1)):
                kind = batch.column(0).slice(a, b - a).to_numpy(zero_copy_only=False)
                owner, grams = features(batch.column(1).slice(a, b - a).to_pylist())
                unique, at = np.unique(grams, return_inverse=True)
                p = np.bincount(at, kind[owner], len(unique)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(unique), pa.array(p), pa.array(np.bincount(at, minlength=len(unique)) - p)], names=["gram", "p", "u"])

    counts = sample.select("positive", "text").mapInArrow(run, "gram long, p long, u long").groupBy("gram").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    both = (F.col("p") + F.col("u") + 1) / (positive + unlabelled + 2)
    z = F.abs(F.col("p") / positive - F.col("u") / unlabelled) / F.sqrt(both * (1 - both) * (1 / positive + 1 / unlabelled))
    best = counts.where(F.col("p") >= least).select("gram", z.alias("z")).where(F.col("z") >= SURE).orderBy(F.desc("z"), "gram").limit(most)  # a bound of the model
    return np.array(sorted(r["gram"] for r in best.collect()), np.int64)


def fit(df: DataFrame, labels: DataFrame, prior: float | None = None, sample_positive: int = SAMPLE_POSITIVE, sample_unlabelled: int = SAMPLE_UNLABELLED, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from the confirmed toxic rows of df, and from rows of df whose labels are not looked at."""
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).dropna().groupBy("id").agg(F.min("y").alias("y"))
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id IS NOT NULL")
    marked = written(texts.select("id").join(known, "id"), "marked")
    n, toxic = marked.agg(F.count(F.lit(1)), F.sum((F.col("y") == 1).cast("long"))).first()
    prior = prior if prior is not None else (toxic or 0) / max(n, 1)
    confirmed = _sampled(marked.where("y = 1").select("id").distinct(), sample_positive)  # bounded: ids alone
    anyone = _sampled(texts, sample_unlabelled).select(F.lit(0).alias("positive"), "text")
    sample = written(texts.join(F.broadcast(confirmed), "id").select(F.lit(1).alias("positive"), "text").unionAll(anyone), "sample")
    sizes = {r["positive"]: r["count"] for r in sample.groupBy("positive").count().collect()}
    model = Model(prior)
    if len(sizes) == 2 and 0 < prior < 1:
        model = Model(prior, screened(sample, sizes[1], sizes[0]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a, b in byte_slices(batch.column(1)):
                    owner, item = model.find(batch.column(1).slice(a, b - a).to_pylist())
                    cuts = np.searchsorted(owner, np.arange(b - a + 1))
                    bags = [item[i:j].astype("<i4").tobytes() for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(bags, pa.binary())], names=["positive", "bag"])

        # in an order of their own, so that the model doesn't depend on how rows are dealt out
        bags = sorted((r["positive"], bytes(r["bag"])) for r in sample.select("positive", "text").mapInArrow(run, "positive int, bag binary").collect())
        model.learn(*(Bags([np.frombuffer(b, "<i4") for kind, b in bags if kind == own]) for own in (1, 0)))
    discard(marked, sample)
    return model


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(model)
    return map_texts(df, lambda: shared.value.judge, "score double, predicted int", id_col, text_col)


def op12_pu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = score(docs, fit(docs.where(~held_out("doc_id", 5, 0)), table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", "predicted")
