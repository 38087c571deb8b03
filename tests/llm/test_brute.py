"""Language, quality and the whole pipeline against plain versions that look at one text, passage or pair at a time."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import regex
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from simgate.llm import bpe, language, pii, quality
from simgate.llm.pretokens import mix

from .test_operators import BASE, EUHT, ODD, THUE, brute_contamination, by_id, edited, frame, prose

GERMAN = "üng ßen ver zu äch ieu lich".split()


# op5


def brute_profile(texts):
    """The ranks of the most frequent n-grams; equal counts in the operator's stated order of hash."""

    def key(gram):
        value = 0
        for c in gram:
            value = value << 21 | ord(c)
        return int(mix(np.array([value], np.uint64))[0]) >> 24

    counts = Counter()
    for text in texts:
        for word in regex.findall(r"\p{L}+", (text or "").lower()):
            padded = f" {word} "
            counts.update(padded[i : i + n] for n in (1, 2, 3) for i in range(len(padded) - n + 1))
    del counts[" "]
    order = sorted((-n, key(g) & int(language.LOW), key(g), g) for g, n in counts.items())
    return {g: rank for rank, (*_, g) in enumerate(order[: language.PROFILE])}


def brute_language(profiles, text):
    own = brute_profile([text])
    if not own or not profiles:
        return "und", 0.0
    far = {name: sum(abs(p[g] - r) if g in p else language.PROFILE for g, r in own.items()) / (len(own) * language.PROFILE) for name, p in profiles.items()}
    best = min(far, key=lambda name: (far[name], name))
    return best, 1 - far[best]


def brute_profiles(rows):
    return {lang: brute_profile([t for _, t, own in rows if own == lang]) for lang in {r[2] for r in rows} - {None}}


def test_language_is_the_brute_forces(spark):
    texts = [*ODD, *(prose(30, s) for s in range(20)), *(prose(30, s, GERMAN) for s in range(20)), prose(60_000, 77), BASE, BASE]
    rows = [(None if i % 11 == 0 else i // 2 if i % 7 == 0 else i, t, [None, "en", "de"][i % 3] if i < 21 else "en" if i < 41 else "de") for i, t in enumerate(texts)]
    df = spark.createDataFrame([(*r, "clash", 0.5, n) for n, r in enumerate(rows)], "doc_id long, text string, lang string, lang_pred string, score double, id int").repartition(3)
    learned = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 != 0
    profiles = brute_profiles([r for r in rows if learned(r[0])])
    got = language.predict(df, language.fit(df.where(~language.held_out("doc_id", 5, 0))))
    assert got.columns == ["doc_id", "lang_pred", "score"]
    shown = lambda rows: sorted((-1 if i is None else i, lang, round(score, 9)) for i, lang, score in rows)
    assert shown(map(tuple, got.collect())) == shown((i, *brute_language(profiles, t)) for i, t, _ in rows)
    assert language.predict(df.where("false"), language.fit(df)).count() == 0


# op8


def brute_passages(text):
    marks = [chr(c) for c in range(33, 128) if not chr(c).isalnum()]

    def fine(c):
        if c in marks:
            return marks.index(c)
        kinds = [("[A-Z]", quality.UPPER), ("[a-z]", quality.LOWER), (r"\p{L}", quality.OTHER_LETTER), (r"\p{N}", quality.DIGIT), (" ", quality.BLANK), ("\n", quality.LINE)]
        return next((k for p, k in kinds if regex.fullmatch(p, c)), quality.OTHER)

    coarse = lambda c: {quality.UPPER: 0, quality.LOWER: 1, quality.OTHER_LETTER: 1, quality.DIGIT: 2, quality.BLANK: 3, quality.LINE: 4}.get(fine(c), 5)
    out = []
    for k in range(max(1, math.ceil(len(text) / quality.PASSAGE))):
        part = text[k * quality.PASSAGE : (k + 1) * quality.PASSAGE]
        total, x = max(len(part), 1), np.zeros(quality.FEATURES)
        for c in part:
            x[fine(c)] += 1 / total
        for a, b in zip(part, part[1:], strict=False):
            x[quality.KINDS + coarse(a) * quality.COARSE + coarse(b)] += 1 / total
        words = re.findall(r"[^ \n]+", part)
        n = max(len(words), 1)
        x[-4:] = sum(map(len, words)) / n / 10, (len(words) - len(set(words))) / n, sum(a == b for a, b in zip(words, words[1:], strict=False)) / n, total / quality.PASSAGE
        out.append(np.sqrt(x))
    return out


def brute_score(model, text):
    """Gated attention one passage at a time, by the formulas of the paper."""
    w, sigmoid = model.w, lambda v: 1 / (1 + math.exp(-v))
    seen = [np.tanh(((x - model.mean) / model.spread) @ w["encode"] + w["encode_0"]) for x in brute_passages(text or "")]
    raw = [sum(math.tanh(h @ w["tanh"][:, j]) * sigmoid(h @ w["gate"][:, j]) * w["weigh"][j, 0] for j in range(quality.ATTENTION)) for h in seen]
    weights = [math.exp(e - max(raw)) for e in raw]
    bag = sum(a * h for a, h in zip(weights, seen, strict=True)) / sum(weights)
    return sigmoid(float(bag @ w["score"][:, 0] + w["score_0"][0]))


def test_quality_scores_are_the_brute_forces(spark):
    texts = [*ODD, *(prose(90, s) for s in range(20)), *(" | ".join(prose(60, s).split()) for s in range(20)), prose(9_000, 78)]
    ids = [None if i % 13 == 0 else i // 2 if i % 7 == 0 else i for i in range(len(texts))]
    df = spark.createDataFrame([(i, t, 0.5, 7, "x") for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, score double, predicted int, id string").repartition(3)
    labels = [(i, int(i % 2), "x") for i in range(len(texts))] + [(3, 0, "twice"), (None, 1, "no id"), (5, None, "no label")]
    model = quality.fit(df, spark.createDataFrame(labels, "doc_id long, quality int, text string"))
    assert model.learned
    got = quality.score(df, model)
    assert got.columns == ["doc_id", "score", "predicted"]
    rows = got.collect()
    want = sorted((-1 if i is None else i, round(brute_score(model, t), 3)) for i, t in zip(ids, texts, strict=True))
    have = sorted((-1 if r.doc_id is None else r.doc_id, r.score) for r in rows)
    assert [i for i, _ in have] == [i for i, _ in want]
    np.testing.assert_allclose([s for _, s in have], [s for _, s in want], atol=2e-3)
    assert all(r.predicted == (r.score >= 0.5) for r in rows)
    assert quality.score(df.where("false"), model).count() == 0
    assert not quality.fit(df.where("false"), spark.createDataFrame(labels, "doc_id long, quality int, text string")).learned


# pipeline


def brute_pipeline(rows, items, surrogates):
    """(doc_id, text) that the first four stages keep, of (doc_id, text, lang)."""
    profiles = brute_profiles([r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 != 0])
    kept = [(i, t) for i, t, _ in rows if brute_language(profiles, t)[1] > 0]
    sets = {}
    for i, t in kept:
        w = re.findall(r"[^ \t\n\v\f\r]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))}
    low = {i: i for i in sets}
    for _ in range(4):  # chains in the fixture are shorter
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    low[a] = low[b] = min(low[a], low[b])
    kept = [(i, t) for i, t in kept if low[i] == i and not brute_contamination(t, items)[4]]
    return {i: surrogates.get(t, t) for i, t in kept}


def test_pipeline_is_the_brute_forces(spark, tmp_path):
    item = prose(40, 900)
    private = ["write to me.you@there.org soon " + prose(20, 80), "Ask Mr. John Smith, " + prose(20, 81)]
    texts = [
        *ODD, *(prose(40, s) for s in range(20)), *(prose(40, s, GERMAN) for s in range(20)), *(edited(prose(200, 50), 0.01, s) for s in range(12)), *(edited(prose(200, 51), 0.05, s) for s in range(8)),
        item, prose(30, 901) + " " + item, prose(900, 902) + " " + item, " ".join(item.split()[:13]) + " " + prose(60, 903), *private, private[0], "ภาษา ไทย", "123 456", prose(8_000, 79),
    ]
    rows = [(i, t, [None, "en", "en"][i % 3] if i < len(ODD) else "de" if len(ODD) + 20 <= i < len(ODD) + 40 else "en") for i, t in enumerate(texts)]
    rows = [(i, t, None if t and not t.isascii() and i >= len(ODD) + 40 else lang) for i, t, lang in rows]
    docs = spark.createDataFrame([(*r, "s", len(r[1] or ""), "own", 3) for r in rows], "doc_id long, text string, lang string, source string, n_chars int, doc string, n_tokens int").repartition(3)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    # the surrogates of the two texts with personal data are the operator's; its own tests judge them
    changed = {t: r.text for t, r in zip(private, sorted(pii.surrogates(frame(spark, private), pii.session_key(spark)).collect(), key=lambda r: r.doc_id), strict=True)}
    want = brute_pipeline(rows, [("1", item)], changed)
    assert not {i for i, t in enumerate(texts) if t in (None, "123 456", item)} & set(want) and len(want) > 40 and all(changed[t] != t for t in private)
    library = tiktoken.Encoding("library", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    got = by_id(corpus_pipeline.run(spark, str(tmp_path)))
    assert set(got) == set(want)
    for i, text in want.items():
        ids = library.encode_ordinary(text)
        assert got[i].ids == ids and got[i].n_tokens == len(ids) and got[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest(), i


def test_pipeline_of_empty_tables_missing_ids_and_repeats(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars int, id string"
    bench = spark.createDataFrame([], "item_id long, text string")
    rows = [(None, BASE, "en", "s", 1, "a"), (None, BASE, "en", "s", 1, "b"), (4, prose(50, 1), "en", "s", 1, "c"), (4, prose(50, 1), "en", "s", 1, "d"), (5, THUE, "en", "s", 1, "e"), (6, EUHT, "en", "s", 1, "f"), (7, None, None, None, None, None)]
    for name, data in (("none", []), ("odd", rows)):
        spark.createDataFrame(data, schema).write.parquet(str(tmp_path / name / "documents.parquet"))
        bench.write.parquet(str(tmp_path / name / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
    out = corpus_pipeline.run(spark, str(tmp_path / "odd"))
    assert sorted(out.select(F.coalesce("doc_id", F.lit(-1))).toPandas().iloc[:, 0]) == [-1, 4, 5, 6]
