import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import decontaminate, language_id, quality, url_filter

RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def judged(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, rest = brute.lower_ascii(rest[:cut]), rest[cut:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    fits = [(len(r), v, r) for v, r in RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    best = max(fits, default=None)
    return host, path, best and best[2], best[1] if best else "allow"


def test_urls(spark):
    hosts = ["example.com", "a.B.Example.COM", "notexample.com", "com", "x.org", "example.net", "m.example.net", "", "é.com", ".com", "a..com"]
    paths = ["", "/", "/en/", "/en/7", "/en/71?x=/es/", "/de/8", "/de/9#en", "/es/1", "/EN/7", "?q=/en/", "#/en/"]
    urls = [f"http://{h}{p}" for h in hosts for p in paths] + [None, "", "example.com/en/7", "ftp://x.com/en/\n2", "a://b://c.com/en/"]
    rows = [(i, u, "clash") for i, u in enumerate(urls + urls[:5])]
    pages = spark.createDataFrame(rows, "page_id long, url string, rule string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.url_filter(pages, url_filter.rules_table(spark, RULES)).collect()}
    assert got == {i: judged(u) for i, u, _ in rows}
    nothing = url_filter.url_filter(pages, url_filter.rules_table(spark, RULES).limit(0))
    assert {r["verdict"] for r in nothing.collect()} == {"allow"} and nothing.count() == len(rows)
    assert url_filter.url_filter(pages.limit(0), url_filter.rules_table(spark, RULES)).count() == 0


def test_languages(make, spark):
    rng = random.Random(1)
    syllables = {"xx": ["ka", "to", "mi", "shi", "ru"], "yy": ["gra", "vol", "est", "und", "ble"], "zz": ["où", "éa", "çi", "nê", "la"]}
    text = lambda lang, n: " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))
    train = [(i, text(lang, 80), lang) for i, lang in enumerate(list(syllables) * 20)] + [(900, None, "xx"), (901, "?!", "yy"), (902, "grabl", None)]
    profiles = language_id.learn(make(train, "doc_id long, text string, lang string"))
    assert profiles.names == ["xx", "yy", "zz"]
    tests = [(i, text(lang, 30), lang) for i, lang in enumerate(list(syllables) * 20)] + [(98, None, "und"), (99, "", "und"), (100, "123 !\n", "und"), (101, text("xx", 40_000), "xx"), (5, "kato", "xx")]
    found = language_id.identify(make([(*t, 7) for t in tests], "doc_id long, text string, lang string, score int"), profiles).collect()
    assert len(found) == len(tests) and all(r["lang_pred"] == r["lang"] and 0 <= r["score"] <= 1 for r in found)
    assert language_id.identify(make([]), profiles).count() == 0
    blank = language_id.learn(make([], "doc_id long, text string, lang string"))
    assert [tuple(r) for r in language_id.identify(make([(1, "abc")]), blank).select("lang_pred", "score").collect()] == [("und", 0.0)]


def test_out_of_place_distance_by_hand():
    profiles = language_id.Profiles({"p": [ord("a"), ord("b"), 1 << 21 | ord("a")], "q": [ord("z")]}, size=3)
    codes = language_id.ranked(*language_id.gram_counts("a"), 3)  # a, then the padded pairs by code
    assert codes.tolist() == sorted([ord("a"), 1 << 21 | ord("a"), ord("a") << 21 | 1])
    name, score = profiles.predict("a")
    out = [abs({ord("a"): 0, 1 << 21 | ord("a"): 2}[c] - i) if c in (ord("a"), 1 << 21 | ord("a")) else 3 for i, c in enumerate(codes.tolist())]
    assert name == "p" and score == pytest.approx(1 - sum(out) / 9)


def test_quality(make, spark):
    rng = random.Random(3)
    good = lambda: " ".join(" ".join(rng.choice(["the", "river", "under", "stone", "light"]) for _ in range(9)).capitalize() + "." for _ in range(6))
    bad = lambda: rng.choice([lambda: good().upper().replace(" ", "!! "), lambda: " | ".join(good().split()), lambda: good().replace(" ", " %%% ")])()
    rows = [(i, good() if i % 2 else bad(), i % 2) for i in range(300)]
    docs, labels = make([r[:2] for r in rows]), make([(r[0], r[2]) for r in rows if r[0] < 200] + [(1, None), (3, 0), (None, 1)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    scored = {r["doc_id"]: r["score"] for r in quality.rate(docs, model).collect()}
    assert np.mean([(scored[i] >= quality.CUT) == y for i, _, y in rows if i >= 200]) > 0.95
    odd = quality.rate(make([(1, None), (2, ""), (2, ""), (3, "x " * 200_000)]), model).collect()
    assert len(odd) == 4 and all(0 <= r["score"] <= 1 for r in odd)
    assert quality.rate(make([]), model).count() == 0
    alone = quality.fit(docs, labels.where(F.col("quality") == 1))
    assert {round(r["score"], 6) for r in quality.rate(docs, alone).collect()} == {quality.CUT}


def test_features_by_hand():
    import pyarrow as pa

    from sparkloom.llm import kernels as K

    x = dict(zip(quality.FEATURES, quality.features(*K.utf8(pa.array(["One two. One!!\nONE", ""])))[0], strict=True))
    assert x["distinct"] == pytest.approx(4 / 4) and x["upper"] == pytest.approx(5 / 18) and x["doubled"] == pytest.approx(1 / 4)
    assert x["word_bytes"] == pytest.approx((3 + 4 + 5 + 3) / 4) and x["shouted"] == pytest.approx(1 / 4) and x["lines"] == pytest.approx(1 / 4)


def test_masks_cover_all_substitutions():
    from itertools import combinations

    for wrong in combinations(range(decontaminate.WINDOW), decontaminate.SUBSTITUTED):
        assert any(not {i + j for j in mask} & set(wrong) for mask in decontaminate.MASKS for i in range(decontaminate.WINDOW - mask[-1]))


def test_decontamination(make, spark):
    rng = random.Random(4)
    text = lambda n: [f"t{rng.randrange(3000)}" for _ in range(n)]
    items = [(i, " ".join(text(rng.choice([3, 4, 5, 8, 12, 13, 20, 50])))) for i in range(40)] + [(None, "a b c d e"), (77, None), (5, "again " * 20)]
    rows = [(i, " ".join(text(60))) for i in range(30)]
    for i in range(80):
        own = items[rng.randrange(40)][1].split()
        for _ in range(rng.randrange(4)):
            own[rng.randrange(len(own))] = "SUBST"
        cut = rng.randrange(len(own)) if rng.random() < 0.3 else 0
        rows.append((100 + i, " ".join([*text(rng.randrange(20)), *own[cut:], *text(rng.randrange(20))]).replace(" ", rng.choice([" ", ", ", "\n"])).upper()))
    rows += [(500, None), (501, ""), (502, " ".join(text(30_000))), (100, rows[30][1])]
    docs, bench = make(rows), make(items, "item_id long, text string")
    for part in (4 << 20, 400):
        got = decontaminate.find(docs.withColumn("spans", F.lit(1)), bench, part_bytes=part).collect()
        assert sorted((r["doc_id"], r["items"]) for r in got) == sorted((k, brute.contaminated(t, items)) for k, t in rows)
    assert all(not r["items"] for r in decontaminate.find(docs, bench.limit(0)).collect())
    assert decontaminate.find(make([]), bench).count() == 0


def test_many_parts_of_a_benchmark(make, spark, monkeypatch):
    """50 parts, one after the other, find what one does; no plan holds more than one of them."""
    rng = random.Random(12)
    word = lambda: f"w{rng.randrange(3000)}"
    items = [(i, " ".join(word() for _ in range(rng.choice([6, 20, 40])))) for i in range(120)] + [(3, "twice told " * 10), (None, "x"), (9, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(i, " ".join([*(word() for _ in range(30)), *rng.choice(items[:100])[1].split()[: rng.choice([5, 20, 40])], *(word() for _ in range(20))])) for i in range(40)]
    rows += [(100, None), (100, None), (101, ""), (102, rows[0][1]), (102, rows[0][1]), (None, items[5][1])]
    docs = make(rows)
    size = sum(len(t) + 16 for k, t in items if k is not None and t is not None)
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0)
    whole = decontaminate.find(docs, bench)
    parted = decontaminate.find(docs, bench, part_bytes=size // 50)
    assert parted._jdf.queryExecution().toString().count("MapInArrow") == 0
    one, many = (sorted(([key(r), list(r["items"]), [tuple(x) for x in r["spans"]]] for r in d.collect())) for d in (whole, parted))
    assert one == many
    assert any(x[1] for x in one)
    assert [x[1] for x in one] == [brute.contaminated(t, items) for _, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))]


def test_repeated_tokens_take_memory_by_length():
    """A token 5,000 times against an equal item: counted, not multiplied out; spans as the diagonals one by one give."""
    import tracemalloc

    import pyarrow as pa

    from sparkloom.llm import kernels as K

    items = decontaminate.Items([7], ["buffalo " * 5000])
    tracemalloc.start()
    text = "start here " + "buffalo " * 5000 + "end"
    got = items.spans(*decontaminate.tokens(*K.utf8(pa.array([text, "nothing of the kind", "buffalo " * 12]))))
    assert tracemalloc.get_traced_memory()[1] < 50 << 20
    tracemalloc.stop()
    assert got == [[(7, 0, 5003)], [], []]  # two substitutions on either side at most


def test_dense_and_single_diagonals_agree(monkeypatch):
    import pyarrow as pa

    from sparkloom.llm import kernels as K

    rng = random.Random(13)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randrange(60))) for _ in range(60)]
    items = decontaminate.Items(list(range(20)), [" ".join(rng.choice("abc") for _ in range(rng.randrange(4, 40))) for _ in range(20)])
    found = []
    for dense in (-1, 10**9):
        monkeypatch.setattr(decontaminate, "DENSE", dense)
        found.append(items.spans(*decontaminate.tokens(*K.utf8(pa.array(texts)))))
    assert found[0] == found[1] and any(found[0])
