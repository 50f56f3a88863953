"""Learned models against brute force: pairwise ranking, rank-order profiles, and the queries that use them."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from sparkloom.llm import kernels as K
from sparkloom.llm import language_id, quality


def gram_counts(text):
    """1- to 3-grams of a text, letter by letter."""
    marked = "".join(c if c.isalpha() else "\x01" for c in text.lower())
    if not marked.strip("\x01"):
        return Counter()
    marked = "\x01" + re.sub("\x01+", "\x01", marked).strip("\x01") + "\x01"
    code = lambda s: sum(ord(c) << 21 * (len(s) - 1 - i) for i, c in enumerate(s))
    return Counter(code(marked[i : i + n]) for n in (1, 2, 3) for i in range(len(marked) - n + 1) if marked[i : i + n] != "\x01")


def ranks(counts, size=language_id.PROFILE_SIZE):
    return [c for c, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:size]]


def judged(text, profiles, size=language_id.PROFILE_SIZE):
    own = ranks(gram_counts(text or ""))
    if not own or not profiles:
        return "und", 0.0
    best = min((sum(min(abs(p.index(c) - i), size) if c in p else size for i, c in enumerate(own)), lang) for lang, p in sorted(profiles.items()))
    return best[1], 1 - best[0] / (size * len(own))


def language_rows():
    rng = random.Random(21)
    letters = {"aa": "kotamishe", "bb": "grubldeni", "cc": "äöüßtrens", "dd": "日本語文字"}
    text = lambda lang, n: " ".join("".join(rng.choice(letters[lang]) for _ in range(rng.randint(1, 7))) for _ in range(n))
    rows = [(i, text(lang, rng.choice([1, 4, 30, 200])), lang) for i, lang in enumerate(["aa", "bb", "cc", "dd"] * 9)]
    rows += [(100, None, "aa"), (101, "", "bb"), (102, "12 !? 3", "cc"), (103, text("aa", 9), None), (104, text("bb", 40_000), "bb"), (None, "kota mishe", "aa"), (3, rows[3][1], "dd"), (105, "Kota MISHE 3 kota x", "aa")]
    return rows


def test_profiles_and_predictions_by_force(make, monkeypatch):
    monkeypatch.setattr(language_id, "STRETCH", 1000)
    monkeypatch.setattr(language_id, "HELD", 200)
    rows = language_rows()
    docs = make(rows, "doc_id long, text string, lang string")
    counts = {}
    for _, text, lang in rows:
        if text is not None and lang is not None:
            counts.setdefault(lang, Counter()).update(gram_counts(text))
    want = {lang: ranks(c) for lang, c in counts.items() if c}
    learned = language_id.learn(docs)
    assert learned.names == sorted(want)
    for name, (codes, order) in zip(learned.names, learned.tables):
        assert codes[np.argsort(order)].tolist() == want[name]
    got = language_id.identify(docs, learned, keep=["doc_id", "text"]).collect()
    assert len(got) == len(rows)
    for r in got:
        lang, score = judged(r["text"], want)
        assert (r["lang_pred"], r["score"]) == (lang, pytest.approx(score))


def test_language_query_by_force(spark, tmp_path):
    rows = language_rows()
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    out = lambda key: key is not None and zlib.crc32(str(key).encode()) % 5 == 0
    counts = {}
    for key, text, lang in rows:
        if key is not None and not out(key) and text is not None and lang is not None:
            counts.setdefault(lang, Counter()).update(gram_counts(text))
    profiles = {lang: ranks(c) for lang, c in counts.items() if c}
    from sparkloom.llm import queries_filters

    got = queries_filters.op10_language_id
    found = sorted((tuple(r) for r in got(spark, str(tmp_path)).select("doc_id", "held_out", "lang_pred", "score").collect()), key=str)
    want = sorted(((k, out(k), *judged(t, profiles)) for k, t, _ in rows), key=str)
    assert [r[:3] for r in found] == [r[:3] for r in want]
    assert [r[3] for r in found] == pytest.approx([r[3] for r in want])


def quality_rows():
    rng = random.Random(22)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8)))
    good = lambda: ". ".join(" ".join(word() for _ in range(rng.randint(6, 14))).capitalize() for _ in range(rng.randint(4, 9))) + "."
    bad = lambda: " ".join(rng.choice([word().upper(), "$$$", "!!!", "CLICK", "1234", word()]) for _ in range(rng.randint(5, 60)))
    docs, labels = [], []
    for i in range(80):
        y = rng.random() < 0.5
        docs.append((i, good() if y != (rng.random() < 0.05) else bad()))
        if i % 4:
            labels.append((i, int(y)))
    docs += [(200, None), (201, ""), (None, good()), (5, bad()), (5, docs[5][1]), (202, "x" * 300_000)]
    labels += [(7, 0), (7, 1), (None, 1), (9, None), (300, 1), (10, labels[6][1])]
    return docs, labels


def _features(text):
    return quality.features(*K.utf8(pa.array([text or ""])))[0]


def test_features_do_not_depend_on_the_neighbours():
    docs, _ = quality_rows()
    texts = [t or "" for _, t in docs]
    together = quality.features(*K.utf8(pa.array(texts)))
    assert together == pytest.approx(np.stack([_features(t) for t in texts]))


def test_pairwise_loss_and_threshold_by_force():
    """Weights are where the loss of the drawn pairs is flat and least; no threshold decides more of the sample rightly."""
    rng = np.random.default_rng(3)
    width = len(quality.FEATURES)
    good, bad = rng.normal(0.4, 1, (60, width)), rng.normal(0, 1, (50, width))
    model = quality.fit_pairs(good, bad, pairs=4000, seed=5)
    draw = np.random.default_rng(5)
    z = lambda x: np.clip((x - model.mean) / model.scale, -6, 6)
    d = z(good)[draw.integers(60, size=4000)] - z(bad)[draw.integers(50, size=4000)]
    loss = lambda w: np.log1p(np.exp(-(d @ w))).sum() + 0.5 * 1e-3 * 4000 * (w @ w)
    least = loss(model.weights)
    for i in range(width):
        for step in (1e-3, -1e-3):
            moved = model.weights.copy()
            moved[i] += step
            assert loss(moved) > least
    latent, label = np.concatenate([model.latent(good), model.latent(bad)]), np.r_[np.ones(60), np.zeros(50)]
    right = lambda t: ((latent >= t) == (label == 1)).sum()
    assert right(model.threshold) == max(right(t) for t in [*latent, latent.max() + 1])
    assert ((model.score(np.concatenate([good, bad])) >= quality.CUT) == (latent >= model.threshold)).all()


def test_quality_query_by_force(spark, tmp_path):
    from sparkloom.llm import queries_filters

    docs, labels = quality_rows()
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    held = lambda key: key is not None and zlib.crc32(str(key).encode()) % 4 == 2
    of = {}
    for key, y in labels:
        if key is not None and y is not None and not held(key):
            of.setdefault(key, set()).add(y)
    import xxhash

    least = lambda t: (lambda h: h - 2**64 if h >= 2**63 else h)(xxhash.xxh64_intdigest(t.encode(), 42))
    texts = {}
    for key, text in docs:
        if key is not None and text is not None:
            texts[key] = min(texts.get(key, text), text, key=least)
    chosen = sorted(k for k, ys in of.items() if len(ys) == 1 and k in texts)
    x = np.array([_features(texts[k]) for k in chosen])
    y = np.array([next(iter(of[k])) for k in chosen])
    model = quality.fit_pairs(x[y == 1], x[y == 0])
    want = sorted(((k, held(k), float(model.score(_features(t)[None])[0])) for k, t in docs), key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    got = sorted((tuple(r) for r in queries_filters.op4_quality_ranking(spark, str(tmp_path)).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    assert [r[:2] for r in got] == [r[:2] for r in want]
    assert [r[2] for r in got] == pytest.approx([r[2] for r in want], abs=1e-6)
    assert all(r[3] == int(r[2] >= 0.7) for r in got)


@pytest.mark.parametrize("bad_share", [0.5, 0.02])
def test_every_labelled_row_is_fitted(make, monkeypatch, bad_share):
    """Blocks of few rows, few pairs, a rare label: moments, weights and threshold are those of all rows, not of a sample."""
    monkeypatch.setattr(quality, "RANKED", 50)
    monkeypatch.setattr(quality, "LEAST_ROWS", 4)
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8)))
    noisy = lambda y: " ".join(rng.choice([word().upper(), "$$", "1234"]) if rng.random() < (0.2 if y else 0.4) else word() for _ in range(rng.randint(3, 40))) + "."
    truth = [int(rng.random() >= bad_share) for _ in range(600)]
    texts = [noisy(y) for y in truth]
    texts[:6], truth[:6] = ["the same. " * 3] * 6, [0, 1, 1, 0, 1, 0]  # equal texts, unlike labels
    model = quality.fit(make(list(enumerate(texts))), make(list(enumerate(truth)), "doc_id long, quality int"), rows=40, pairs=30)
    x, y = np.stack([_features(t) for t in texts]), np.array(truth)
    assert model.mean == pytest.approx(x.mean(0)) and model.scale == pytest.approx(np.maximum(x.std(0), 1e-6))

    import xxhash

    blocks, differences = -(-max(y.sum(), (1 - y).sum()) // 40), []
    deal = {v: min(blocks, -(-4 * blocks // (y == v).sum())) for v in (0, 1)}
    home = [(lambda h: h - 2**64 if h >= 2**63 else h)(xxhash.xxh64_intdigest(i.to_bytes(8, "little"), 42)) for i in range(600)]
    used = set()
    for b in range(blocks):
        own = [i for i in range(600) if any((home[i] + t) % blocks == b for t in range(deal[y[i]]))]
        good, bad = [[i for i in own if y[i] == v] for v in (1, 0)]
        if good and bad:
            used |= set(own)
            differences.append(quality._differences(model, x[good], x[bad], 30, 7 + b))
    assert blocks > 5 and used == set(range(600))
    d = np.concatenate(differences)
    loss = lambda w: np.log1p(np.exp(-(d @ w))).sum() + 0.5 * 1e-3 * len(d) * (w @ w)
    for i in range(len(quality.FEATURES)):
        for step in (1e-3, -1e-3):
            moved = model.weights.copy()
            moved[i] += step
            assert loss(moved) > loss(model.weights)
    latent = model.latent(x)
    right = lambda t: ((latent >= t) == (y == 1)).sum()
    assert right(model.threshold) == max(right(t) for t in [*latent, latent.max() + 1])


def test_pairs_leave_no_row_out():
    """Rows that no random pair has get one of their own."""
    model = quality.Ranker(np.zeros(17), np.ones(17), np.zeros(17), 0.0)
    good, bad = np.eye(17)[:12] * 2, -np.eye(17)[12:]
    d = quality._differences(model, good, bad, 3, 1)
    assert ((d == 2).any(0)[:12]).all() and ((d == 1).any(0)[12:]).all()


def test_quality_beside_clashing_columns(spark):
    """Columns named as the operator's own, and labels without rows."""
    docs = spark.createDataFrame([(1, "one two.", "r", 2.0), (2, None, None, None)], "doc_id long, text string, row string, features double")
    model = quality.fit(docs, spark.createDataFrame([], "doc_id long, quality int"))
    got = quality.rate(docs, model).collect()
    assert {tuple(got[0].asDict())} == {("doc_id", "text", "row", "features", "score")}
    assert all(r["score"] == pytest.approx(quality.CUT) for r in got)


def test_languages_beside_clashing_columns(spark):
    """Columns named as the operator's own: lang_pred and score are replaced, all others stay; rows repeat; no rows give no rows."""
    schema = "doc_id long, text string, lang string, row string, score string, lang_pred int, gram long"
    rows = [(1, "kota mishe", "aa", "r", "s", 1, 2), (1, "kota mishe", "aa", "r", "s", 1, 2), (2, "grub lden", "bb", None, None, None, None)]
    docs = spark.createDataFrame(rows, schema)
    learned = language_id.learn(docs)
    got = language_id.identify(docs, learned).collect()
    assert sorted((r["doc_id"], r["row"] or "", r["lang_pred"]) for r in got) == [(1, "r", "aa"), (1, "r", "aa"), (2, "", "bb")]
    nothing = spark.createDataFrame([], schema)
    assert language_id.identify(nothing, language_id.learn(nothing)).count() == 0
    assert language_id.identify(docs, language_id.learn(nothing)).first()["lang_pred"] == "und"
