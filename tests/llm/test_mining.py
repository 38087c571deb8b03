"""Phrases, spelling variants and toxicity against plain versions, with odd rows, empty tables and repeated runs."""

import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from simgate.llm import collocations, toxicity, variants
from simgate.llm.collocations import OP11_SQL

from .test_operators import ODD, empty, prose

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def docs(spark, rows):
    """Columns whose names clash with those that operators make."""
    return spark.createDataFrame([(i, t, lang, "x", 1.5, i) for i, t, lang in rows], "doc_id long, text string, lang string, phrase string, score double, n long").repartition(3)


# op11


def phrase_rows():
    r = random.Random(3)
    words = "New york stock exchange the of a b Über naïve x1 \x00y".split(" ")
    texts = [" ".join(r.choices(words, k=r.randint(0, 30))) + r.choice([".", "\n", " ; ", "!?", "\t", "\x0b", ""]) + "the New york  stock\texchange" * r.randint(0, 2) for _ in range(400)]
    texts += ["a a a a a a a a a a a a a", "  ", "", None, ".,;", "one", "the of " * 3000]
    rows = [(i, t, r.choice(["en", "de", None, "und"])) for i, t in enumerate(texts)]
    return [*rows, *rows[:40], (None, "the of a the of a", "en")]


def brute_phrases(rows, max_n=3, least=10, share=50, top=2000):
    counts, total = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            words = tuple(w for w in re.split(r"[ \t]+", piece) if w)
            total[lang] += len(words)
            counts.update((lang, words[i : i + n]) for n in range(1, max_n + 1) for i in range(len(words) - n + 1))
    inside = lambda small, large: any(large[i : i + len(small)] == small for i in range(len(large) - len(small) + 1))
    found = {}
    often = {k: f for k, f in counts.items() if f >= least and len(k[1]) > 1}
    for (lang, p), a in often.items():
        if any(own == lang and len(q) > len(p) and 100 * f >= share * a and inside(p, q) for (own, q), f in often.items()):
            continue
        cuts = [(1_000_000 * a * a // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        found.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), a, counts[lang, p[:k]], counts[lang, p[k:]], total[lang], score))
    return sorted((lang, rank, x[2].decode(), *x[3:]) for lang, own in found.items() for rank, x in enumerate(sorted(own)[:top], 1))


def as_rows(df):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


@pytest.mark.parametrize("max_n", [2, 3, 5])
def test_phrases_are_the_brute_forces(spark, max_n, monkeypatch):
    monkeypatch.setattr(collocations, "STEP", 700)  # phrases cross the steps in which a task counts
    monkeypatch.setattr(collocations, "AT_ONCE", 50)
    rows = phrase_rows()
    got = as_rows(collocations.collocations(docs(spark, rows), max_n=max_n, top=25))
    assert got == brute_phrases(rows, max_n, top=25) and len(got) > 40


def test_phrase_ties_and_share(spark):
    rows = [(i, t, "en") for i, t in enumerate(["zz yy.", "bb aa.", "ñn öo."] * 10 + ["p q r. "] * 5 + ["p q. "] * 5 + ["s t u. "] * 9 + ["s t. s t."] * 5)]
    got = as_rows(collocations.collocations(docs(spark, rows), min_count=5))
    assert got == brute_phrases(rows, least=5) and [r[2] for r in got if r[3] == 10 and r[2] != "p q"][:3] == ["bb aa", "zz yy", "ñn öo"]


def test_phrases_of_nothing(spark):
    assert collocations.collocations(docs(spark, [(1, "a", "en")]).where("false")).collect() == []
    assert collocations.collocations(docs(spark, [(1, None, None), (2, "", "en"), (3, ".;", "de"), (4, "once only", "de")])).collect() == []


def test_phrase_scores_beyond_64_bits(spark):
    big = 5 * 10**12
    counts = spark.createDataFrame([("en", "a", big), ("en", "b", 7 * big), ("en", "a b", big - 3), ("en", "", 9 * big)], "lang string, phrase string, f long")
    got = collocations.scored(counts).first()
    assert got.score == 1_000_000 * (big - 3) ** 2 // (7 * big * big)


def test_phrase_sql(spark, tmp_path):
    rows = [r for r in phrase_rows() if r[1] is None or "\x00" not in r[1]]
    docs(spark, rows).coalesce(1).write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/d/*.parquet')")
    want = con.execute(f"SELECT lang, rank, phrase, a, l, r, n, score FROM ({OP11_SQL})").fetchall()
    assert sorted(want) == brute_phrases(rows)


def test_phrase_counts_cross_the_network_once(spark):
    plan = collocations.phrase_counts(docs(spark, phrase_rows()[:9]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange shufflepartitionid") == 1 and "hashpartitioning" not in plan


# op13


def brute_variants(rows, least_length=5, least_count=3, ratio=2):
    counts = Counter()
    for i, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            k = h % len(run)
            counts[run[:k] + run[k + 1 :] if h % 97 == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= least_length and n >= least_count}

    def near(a, b):
        if abs(len(a) - len(b)) > 1 or a == b:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    links = {w: [v for v in words if near(w, v)] for w in words}
    best = {w: min(v, key=lambda x: (-words[x], x)) for w, v in links.items() if v}
    form = {w: b for w, b in best.items() if words[b] >= ratio * words[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w, ""), root(w), n, len(links[w]), words[form[w]] if w in form else -1) for w, n in words.items())


def variant_rows(seed=1):
    r = random.Random(seed)
    base = ["".join(r.choices("abcdeé", k=r.randint(5, 9))) for _ in range(40)] + ["aabbaabb", "aabaabb", "ßtraße", "straße", "ÿÿÿÿÿ", "×÷×÷×", "Éclair", "eclair", "abcdef" * 30]
    rows = []
    for i in range(250):
        words = []
        for w in r.choices(base, weights=[1 / (k + 1) for k in range(len(base))], k=40):
            if r.random() < 0.3:
                k = r.randrange(len(w))
                w = r.choice([w[:k] + w[k + 1 :], w[:k] + r.choice("abcdeé") + w[k + 1 :], w[:k] + r.choice("abcdeé") + w[k:]])
            words.append(w.upper() if r.random() < 0.1 else w)
        rows.append((i, r.choice([" ", "-", "1", "漢"]).join(words), "en"))
    return [*rows, *rows[:9], (None, "wholly wholly wholly wholy wholy wholy", "en"), (900, None, "en"), (901, "", None), (902, "1234 漢字", "en"), (903, " ".join(base) * 300, "en")]


def as_variants(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in df.collect())


@pytest.mark.parametrize("together", [60_000, 20])
def test_variants_are_the_brute_forces(spark, together, monkeypatch):
    monkeypatch.setattr(variants, "TOGETHER", together)
    monkeypatch.setattr(variants, "AT_ONCE", 5_000 if together == 20 else 1_000_000)
    rows = variant_rows()
    got = as_variants(variants.variants(docs(spark, rows)))
    assert got == brute_variants(rows) and any(x[2] not in (x[0], x[1]) for x in got)  # some roots are two steps away


def test_variant_slips_and_ties(spark):
    rows = [(i, "planet " * 4 + "planat planat planat plenet plenet plenet", "en") for i in range(400)]  # so many ids that some occurrences slip
    got = as_variants(variants.variants(docs(spark, rows)))
    assert got == brute_variants(rows) and any(len(w[0]) == 5 for w in got)
    tied = [(0, "abcde abcde abcde abcdf abcdf abcdf abcdx abcdx abcdx abcdx abcdx abcdx", "en")]
    assert as_variants(variants.variants(docs(spark, tied), slip=1 << 40)) == [("abcde", "abcdx", "abcdx", 3, 2, 6), ("abcdf", "abcdx", "abcdx", 3, 2, 6), ("abcdx", "", "abcdx", 6, 2, -1)]


def test_variants_of_nothing(spark):
    assert variants.variants(docs(spark, [(1, "a", "en")]).where("false")).collect() == []
    assert variants.variants(docs(spark, [(1, None, "en"), (2, "too few words here", "en")])).collect() == []


def test_neighbourhoods_are_whole_and_distinct():
    r = np.random.default_rng(5)
    words = ["".join(r.choice(list("ab"), size=n)) for n in (5, 6, 7, 8, 9, 10) for _ in range(12)]
    words = sorted(set(words))
    alphabet = np.frombuffer(b"abc", np.uint8)
    for word in words:
        want = {word[:i] + word[i + 1 :] for i in range(len(word))} | {word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in "abc"} | {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in "abc"}
        group = variants.Group([word, *sorted(want - {word})], np.zeros(len(want - {word}) + 1, np.int64))
        made = []
        for kind in (variants.DELETE, variants.REPLACE, variants.INSERT):
            place = np.arange(len(word) + (kind == variants.INSERT))
            made += group.texts(kind, *group.edits(kind, np.zeros(len(place), np.int64), place, alphabet))
        assert sorted(made) == sorted(want - {word})


# op12


def toxic_rows(n=900, seed=2):
    r = random.Random(seed)
    bad = ["zorkface", "grumplump", "Blechnarr"]
    rows, marks = [], []
    for i in range(n):
        toxic = r.random() < 0.15
        words = prose(r.randint(5, 400), seed * 10_000 + i).split()
        for _ in range(r.randint(1, 4) if toxic else 0):
            words.insert(r.randrange(len(words) + 1), r.choice(bad) + r.choice(["", "en", "!"]))
        rows.append((i, " ".join(words), "en"))
        marks.append((i, int(toxic)))
    return rows, marks


def labels(spark, marks):
    return spark.createDataFrame(marks, "doc_id long, toxic int")


def test_toxicity_learns_from_positives_and_unlabelled(spark):
    rows, marks = toxic_rows()
    known = [m for m in marks if m[0] % 5]
    frame = docs(spark, rows)
    model = toxicity.fit(frame.where("doc_id % 5 <> 0"), labels(spark, [m for m in known if m[0] % 3]))
    again = toxicity.fit(frame.where("doc_id % 5 <> 0").repartition(5), labels(spark, [m for m in known if m[0] % 3]))
    assert np.allclose(model.w, again.w) and np.array_equal(model.known, again.known)
    got = {r.doc_id: r for r in toxicity.score(frame, model).collect()}
    held = [m for m in marks if m[0] % 5 == 0]
    assert sum(got[i].predicted != y for i, y in held) <= 0.03 * len(held) and all(got[i].predicted == (got[i].score >= 0.5) for i, _ in marks)
    # no label of an unlabelled text matters: turning all negatives into missing labels changes the prior alone
    only = toxicity.fit(frame.where("doc_id % 5 <> 0"), labels(spark, [m for m in known if m[0] % 3 and m[1]]), prior=model.prior)
    assert np.allclose(model.w, only.w)


def test_toxicity_risk_by_its_definition():
    r = np.random.default_rng(3)
    model = toxicity.Model(0.3, np.arange(4))
    for positive, unlabelled in ((r.normal(size=20), r.normal(size=50)), (r.normal(3, 1, 20), r.normal(-6, 1, 50))):
        loss = lambda z: np.log(1 + np.exp(-z))
        gain, rest = model.risk(positive, unlabelled)
        assert np.isclose(gain, 0.3 * np.mean([loss(z) for z in positive])) and np.isclose(rest, np.mean([loss(-z) for z in unlabelled]) - 0.3 * np.mean([loss(-z) for z in positive]))
        p, u = model.slopes(positive, unlabelled)
        goal = (lambda a, b: sum(model.risk(a, b))) if rest >= 0 else (lambda a, b: -model.risk(a, b)[1])
        for k in range(3):
            for slopes, at in ((p, 0), (u, 1)):
                step = [positive.copy(), unlabelled.copy()]
                step[at][k] += 1e-6
                assert np.isclose((goal(*step) - goal(positive, unlabelled)) / 1e-6, slopes[k], atol=1e-6)


def test_toxicity_features_are_the_brute_forces():
    texts = [t for t in ODD if t is None or len(t) < 4000]
    owner, grams = toxicity.features(texts)
    import regex

    sizes = np.bincount(owner, minlength=len(texts))
    for i, text in enumerate(texts):
        words = set(regex.findall(r"\p{L}+", (text or "").lower()))
        kinds = {("w", w) for w in words} | {(n, w[:n]) for n in toxicity.BEGINNINGS for w in words if len(w) > n} | {("e", w[-toxicity.ENDING :]) for w in words if len(w) > toxicity.ENDING}
        assert sizes[i] == len(kinds)


def test_toxicity_of_odd_rows_and_without_labels(spark):
    frame = docs(spark, [(i, t, "en") for i, t in enumerate(ODD)] + [(None, "x", "en"), (3, ODD[3], "en")])
    none = toxicity.fit(frame, labels(spark, []))
    got = toxicity.score(frame, none).collect()
    assert len(got) == len(ODD) + 2 and {(r.score, r.predicted) for r in got} == {(0.0, 0)}
    one = toxicity.fit(frame, labels(spark, [(3, 1), (3, 0), (4, 0), (None, 1)]))  # of several labels the least
    assert one.prior == 0.0
    rows, marks = toxic_rows(300, 4)
    model = toxicity.fit(docs(spark, rows), labels(spark, marks))
    both = {r.doc_id: r.score for r in toxicity.score(frame, model).collect()}
    assert both[0] == both[1] == 1 / (1 + np.exp(-model.b)) and all(0 <= s <= 1 for s in both.values())
    assert toxicity.score(empty(spark), model).collect() == []
    assert toxicity.fit(docs(spark, rows).where("false"), labels(spark, marks)).learned is False
    assert toxicity.score(docs(spark, [(1, "zorkface " + prose(20_000, 8), "en")]), model).where(F.col("score") >= 0).count() == 1


# op8: one very long text among the labels


def test_quality_of_very_long_texts(spark, monkeypatch):
    from simgate.llm import quality

    long = prose(9_000, 41) + " 漢字 \n" + prose(3_000, 42)
    whole = quality.passages([long, None, "short"])
    monkeypatch.setattr(quality, "PART", 3 * quality.PASSAGE)
    parts = quality.passages([long, None, "short"])
    assert np.array_equal(whole[0], parts[0]) and np.array_equal(whole[1], parts[1])
    rows = np.arange(10)[:, None]
    assert quality.spread(rows, 4).ravel().tolist() == [0, 2, 5, 7] and quality.spread(rows, 10) is rows
    # a labelled text a thousand times as long as the others leaves their share of the sample as it is
    texts = [(i, prose(60, i) if i % 2 else "A1! " * 60, "en") for i in range(200)] + [(200, prose(60_000, 7), "en")]
    frame = docs(spark, texts)
    marks = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(200, 1)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality.Model, "learn", lambda self, bags, y: seen.append([len(b) for b in bags]) or self)
    quality.fit(frame, marks, sample_passages=500, bag_passages=20)
    quality.fit(frame, marks, sample_passages=500, bag_passages=10**6)
    assert len(seen[0]) > 150 and max(seen[0]) <= 20 and len(seen[1]) < 150
