import random

import brute
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparkloom.llm import queries


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(9)
    syllables = {"aa": ["ka", "to", "mi", "shi", "ru", "no"], "bb": ["gra", "vol", "est", "und", "ble", "ik"]}
    word = lambda lang: "".join(rng.choice(syllables[lang]) for _ in range(rng.randint(2, 6)))
    text = lambda lang, n=80: "\n".join(" ".join(word(lang) for _ in range(20)) for _ in range(n // 20))
    clean = [(i, text(lang), lang, "s", 0) for i, lang in enumerate(["aa", "bb"] * 20)]
    item = " ".join(word("aa") for _ in range(30))
    copied = clean[3][1]
    lines = clean[6][1].split("\n")
    near = "\n".join([*lines[:-1], lines[-1] + " ending"])
    odd = [(100, copied, "bb", "s", 0), (101, near, "aa", "s", 0), (102, text("aa", 40) + " " + item + " " + word("aa"), "aa", "s", 0), (103, None, "aa", "s", 0), (104, "12 !", None, "s", 0), (105, text("bb", 20_000), "bb", None, 0)]
    # alike as wholes, without a line in common
    base = [word("bb") for _ in range(100)]
    odd += [(106, " ".join(base), "bb", "s", 0), (107, " ".join([*base[:50], "\n", *base[50:-1]]), "bb", "s", 0)]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(clean + odd, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), [r[0] for r in clean]


def test_stages(spark, folder):
    path, clean = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, left = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, path).collect(), docs.schema)
        assert docs.columns == columns
        left[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert set(clean) <= set(left[name]), name
    assert {103, 104} & set(left["language"]) == set() and 100 in left["language"]
    assert 100 not in left["lines"] and {106, 107} <= set(left["lines"])
    assert 107 not in left["near copies"] and 106 in left["near copies"]
    assert 102 in left["near copies"] and 102 not in left["benchmark"]
    packed = corpus_pipeline.run(spark, path)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == set(left["benchmark"])
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0
    groups = brute.joined(sorted(left["lines"].items()), 5, 4, 5)
    assert set(left["near copies"]) == {g[1] for g in groups}


def _lines_by_force(rows):
    """(doc_id, text) without repeated and similar lines; all pairs of distinct lines that share half of their words are compared."""
    seen = {}
    for key, text in sorted(rows):
        for at, line in enumerate(text.split("\n")):
            plain = " ".join(line.lower().split())
            if plain:
                seen.setdefault(plain, []).append((key, at))
    lines = sorted(seen)
    sets = [set(x.split()) for x in lines]
    holders = {}
    for i, own in enumerate(sets):
        for w in own:
            holders.setdefault(w, []).append(i)
    pairs = {(j, i) for own in holders.values() for i in own for j in own if j < i}
    links = []
    for j, i in pairs:
        most = max(len(lines[i]), len(lines[j]))
        if 2 * len(sets[i] & sets[j]) >= min(len(sets[i]), len(sets[j])) and abs(len(lines[i]) - len(lines[j])) <= most * 0.1 and brute.edit_distance(lines[i], lines[j]) <= int(most * 0.1 + 1e-9):
            links.append((i, j))
    gone = set()
    for group in brute.groups(links, len(lines)):
        gone |= set(sorted(x for i in group for x in seen[lines[i]])[1:])
    out = []
    for key, text in rows:
        kept = [x for at, x in enumerate(text.split("\n")) if (key, at) not in gone]
        out.append((key, "\n".join(kept) if len(kept) < len(text.split("\n")) else text))
    return [(k, t) for (k, t), (_, before) in zip(out, rows) if t == before or t.strip()]


def test_run_by_force(spark, folder):
    """All of run() against plain versions of the five stages: pieces with their ids' checksums, and sequences as few as best fit needs."""
    import zlib

    import numpy as np
    import public_tokenizers
    from test_learned import gram_counts, judged, ranks
    from tokenizers import Tokenizer

    path, _ = folder
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text", "lang").collect()]
    item = [tuple(r) for r in spark.read.parquet(f"{path}/benchmark.parquet").collect()]
    counts = {}
    for _, text, lang in rows:
        if text is not None and lang is not None:
            counts.setdefault(lang, gram_counts("")).update(gram_counts(text))
    profiles = {lang: ranks(c) for lang, c in counts.items() if c}
    kept = []
    for key, text, _ in rows:
        lang, score = judged(text, profiles)
        if lang != "und" and score >= corpus_pipeline.LEAST_SCORE:
            kept.append((key, text))
    kept = _lines_by_force(sorted(kept))
    groups = brute.joined(kept, 5, 4, 5)
    kept = [r for r, g in zip(kept, groups) if r[0] == g[1]]
    kept = [r for r in kept if not brute.contaminated(r[1], item)]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want, sizes = [], []
    for key, text in kept:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        start, piece = 0, 0
        for n in [len(ids) % 2048 or 2048] + [2048] * ((len(ids) - 1) // 2048):
            want.append((key, piece, start, n, zlib.crc32(ids[start : start + n].tobytes())))
            sizes.append(n)
            start, piece = start + n, piece + 1
    got = corpus_pipeline.run(spark, path).collect()
    assert sorted(tuple(r)[:5] for r in got) == sorted(want)
    assert len({r["sequence_id"] for r in got}) == brute.best_fit_bins(sizes, 2048)


def test_stages_take_empty_tables_and_odd_columns(spark, folder):
    path, _ = folder
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, items int, _row string, _doc int"
    for rows in ([], [(None, None, None, None, None, None, None, None, None), (1, "ka to mi shi", None, None, 1, "s", 2, "r", 3)] * 2):
        for name, stage in corpus_pipeline.STAGES:
            docs = spark.createDataFrame(rows, schema)
            out = stage(spark, docs, path)
            assert out.count() <= len(rows)
            assert name == "packing" or out.columns == docs.columns


def test_names_and_registry():
    import __spark_entry__ as entry

    names = entry.queries()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "lines", "near copies", "benchmark", "packing"]
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 11)) and "pipeline" in names
