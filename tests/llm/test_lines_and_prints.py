import hashlib
import random

import brute
import pytest

from sparkloom.llm import imatch, line_dedup


def test_lines(make):
    rng = random.Random(1)
    line = lambda n=14: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    common, long = line(), line(300)
    near = long.replace("w", "v", 1)
    rows = [(i, "\n".join([line(), common if i % 2 else line(), "short", line()])) for i in range(20)]
    rows += [(30, f"{long}\n\n  {common.upper()}  "), (31, f"x\n{near}"), (32, None), (33, ""), (34, "\n\n"), (35, "short"), (36, common), (3, rows[3][1]), (None, common)]
    got = {(r["doc_id"], r["text"]): (r["n_lines"], list(r["removed"])) for r in line_dedup.line_dedup(make(rows)).collect()}
    seen, want = set(), {}
    for key, text in sorted({r for r in rows if r[1] is not None}, key=lambda r: (r[0] is None, r[0] or 0)):
        lines, gone = text.split("\n"), []
        for i, x in enumerate(lines):
            plain = " ".join(x.lower().split())
            plain = long.lower() if plain == near.lower() else plain
            if plain:
                gone += [i] if plain in seen else []
                seen.add(plain)
        want[key, "\n".join(x for i, x in enumerate(lines) if i not in gone)] = (len(lines), gone)
    assert got == want | {(32, None): (0, [])}
    assert line_dedup.line_dedup(make([])).count() == 0


def _described(spark, lines):
    """(bits, keys) of each line, as the operator has them."""
    from pyspark.sql import functions as F

    frame = line_dedup.described(spark.createDataFrame(list(enumerate(lines)), "i int, x string"), "x")
    keys = F.array_compact(F.array(*line_dedup.block_keys(F.col("_bits")), *[f"_s{j}" for j in range(8)]))
    found = {r["i"]: r for r in frame.select("i", "_bits", keys.alias("keys")).collect()}
    return [(found[i]["_bits"], set(found[i]["keys"])) for i in range(len(lines))]


def _similar(a, b):
    return abs(len(a) - len(b)) <= max(len(a), len(b)) * 0.1 and brute.edit_distance(a, b) <= int(max(len(a), len(b)) * 0.1 + 1e-9)


def _groups_by_force(spark, lines):
    """Groups by all pairs that meet, differ in FAR bits at most and are similar."""
    of = _described(spark, lines)
    links = [(i, j) for i in range(len(lines)) for j in range(i) if of[i][1] & of[j][1] and (of[i][0] ^ of[j][0]).bit_count() <= line_dedup.FAR and _similar(lines[i], lines[j])]
    return links, brute.groups(links, len(lines))


def _kept(make, lines):
    return {r["doc_id"] for r in line_dedup.line_dedup(make(list(enumerate(lines)))).collect() if not r["n_removed"]}


def test_fuzzy_groups_follow_keys_and_edits(make, spark):
    """Every pair that meets and is similar is in one group; only such links make groups."""
    rng = random.Random(2)
    base = [[f"w{rng.randrange(10**6)}" for _ in range(rng.choice([7, 20, 60]))] for _ in range(20)]
    lines = []
    for b in base:
        for _ in range(4):
            own = list(b)
            if rng.random() < 0.7:
                own[rng.randrange(len(own))] += rng.choice(["s", "x", ""])
            if rng.random() < 0.2:
                own.insert(rng.randrange(len(own)), "y")
            lines.append(" ".join(own))
    lines = sorted(set(lines))
    rng.shuffle(lines)
    links, groups = _groups_by_force(spark, lines)
    assert links
    assert _kept(make, lines) == {min(g) for g in groups}


def test_families_that_share_buckets(make, spark):
    """50 lines around each of several templates, some of them alike only through others: all of a bucket's pairs count."""
    rng = random.Random(7)
    lines = []
    for _ in range(4):
        template = [f"t{rng.randrange(10**6)}" for _ in range(24)]
        for _ in range(50):
            own = list(template)
            for at in rng.sample(range(6, 24), rng.choice([1, 2, 3, 5, 8])):
                own[at] = f"v{rng.randrange(12)}"
            lines.append(" ".join(own))
    lines = sorted(set(lines))
    rng.shuffle(lines)
    links, groups = _groups_by_force(spark, lines)
    assert len(links) > 300 and any(len(g) > 8 for g in groups) and len(groups) > 8
    assert _kept(make, lines) == {min(g) for g in groups}


def test_lines_that_meet_by_chance_are_not_compared(make, monkeypatch):
    """Keys of few bits put unlike lines into one bucket: their words are not fetched, and like ones are still found."""
    monkeypatch.setattr(line_dedup, "DISTANCE", 4)
    rows, put = {}, line_dedup.Scratch.put

    def counted(self, df, tag):
        out = put(self, df, tag)
        rows[tag] = out.count()
        return out

    monkeypatch.setattr(line_dedup.Scratch, "put", counted)
    rng = random.Random(12)
    lines = [" ".join(f"w{rng.randrange(10**6):06}" for _ in range(12)) for _ in range(3000)]
    lines += [x[:-1] + y for x in lines[:20] for y in "xyz"]
    assert _kept(make, lines) == set(range(3000))
    assert 80 <= rows["compared"] < 150


def test_one_word_set_in_many_orders(make, spark):
    """Lines with equal SimHashes and few similar pairs."""
    rng = random.Random(8)
    names = [f"n{rng.randrange(10**6)}" for _ in range(11)]
    lines = []
    for _ in range(40):
        own = rng.sample(names, 11)
        lines += [" ".join(own), " ".join([*own[:-1], own[-1] + "s"])]
    lines = sorted(set(lines))
    links, groups = _groups_by_force(spark, lines)
    assert links and len(groups) >= 30
    assert _kept(make, lines) == {min(g) for g in groups}


def test_words_that_prevail_do_not_decide(spark):
    """Table rows without a word in common but their bars have different hashes."""
    rng = random.Random(9)
    rows = [" | ".join(f"c{rng.randrange(10**6)}" for _ in range(6)) for _ in range(200)]
    bits = [b for b, _ in _described(spark, rows)]
    assert len(set(bits)) == 200


def test_recall_against_edit_similarity(spark):
    """Of pairs with edit similarity 0.9, the share that meets: changed, added and dropped words in lines of 12 to 100 words."""
    rng = random.Random(10)
    pairs = []
    for _ in range(300):
        words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(12, 100))]
        own = list(words)
        for _ in range(rng.randint(1, max(1, len(words) // 14))):
            at, kind = rng.randrange(len(own)), rng.random()
            own[at : at + (kind < 0.8)] = ["".join(rng.choice("abcdefghij") for _ in range(5))] if kind < 0.9 else []
        a, b = " ".join(words), " ".join(own)
        if a != b and _similar(a, b):
            pairs.append((a, b))
    of = _described(spark, [x for p in pairs for x in p])
    met = sum(bool(of[2 * i][1] & of[2 * i + 1][1]) and (of[2 * i][0] ^ of[2 * i + 1][0]).bit_count() <= line_dedup.FAR for i in range(len(pairs)))
    assert len(pairs) > 200 and met >= 0.9 * len(pairs)


def test_middles_keep_the_edit_distance(spark):
    from pyspark.sql import functions as F

    rng = random.Random(4)
    pairs = []
    for _ in range(150):
        a = [rng.choice(["a", "bb", "ccc", "d"]) for _ in range(rng.randrange(1, 9))]
        b = list(a)
        for _ in range(rng.randrange(4)):
            b[rng.randrange(len(b))] = rng.choice(["a", "x", "bb"])
        b = b[rng.randrange(2) :] or ["z"]
        pairs.append((" ".join(a), " ".join(b)))
    frame = line_dedup.middles(spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, x string, y string"), "x", "y")
    bound = 0
    for r in frame.select("i", F.levenshtein("x", "y").alias("d"), "_aligned").collect():
        assert r["d"] == brute.edit_distance(*pairs[r["i"]])
        assert r["_aligned"] is None or r["_aligned"] >= r["d"]
        bound += r["_aligned"] == r["d"]
    assert bound > 50


def test_piecewise_edits(spark):
    """Never fewer than the edit distance; exact for words that are added, dropped or changed here and there in a long line."""
    rng = random.Random(13)
    pairs, sparse = [("", " a b"), (" a", ""), ("", ""), (" a", " a"), (" a b", " c d e"), (" a a a a", " a a a")], set()
    for _ in range(120):
        a = [rng.choice(["a", "bb", "ccc", "d"]) for _ in range(rng.randrange(1, 9))]
        b = [rng.choice([w, w, w, "x", "bb"]) for w in a][rng.randrange(2) :] or ["z"]
        pairs.append(tuple("".join(f" {w}" for w in words) for words in (a, b)))
    for _ in range(20):
        a = [f"w{rng.randrange(10**6):06}" for _ in range(60)]
        b = list(a)
        b[5:5], b[30:31], b[50:50] = ["yy"], [], [b[50] + "s"]
        sparse.add(len(pairs))
        pairs.append(tuple("".join(f" {w}" for w in words) for words in (a, b)))
    frame = spark.createDataFrame([(i, *p, 10_000) for i, p in enumerate(pairs)], "i int, x string, y string, most int")
    for r in frame.select("i", line_dedup.piecewise("x", "y", "most").alias("n")).collect():
        x, y = pairs[r["i"]]
        assert r["n"] is None if not x or not y else r["n"] >= brute.edit_distance(x, y)
        assert r["i"] not in sparse or r["n"] == brute.edit_distance(x, y)


def test_scattered_edits_need_no_whole_comparison(make, monkeypatch):
    """Words added at one place and dropped or changed at others: such pairs are accepted piece by piece."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(line_dedup, "within", lambda x, y, most: F.lit(False))
    rng = random.Random(14)
    lines = []
    for _ in range(10):
        words = [f"w{rng.randrange(10**6)}" for _ in range(80)]
        lines += [" ".join(words), " ".join([*words[:50], "more", *words[50:70], words[70] + "s", *words[71:]]), " ".join([*words[:60], *words[61:70], "more", "words", *words[70:]])]
    assert _kept(make, lines) == set(range(0, 30, 3))


def test_bits_summed_by_sevens(spark):
    """The same bits as by functions of arrays, for lines that repeat in one document, too."""
    from pyspark.sql import functions as F

    rng = random.Random(15)
    rows = [(i % 3, [rng.getrandbits(64) - 2**63 for _ in range(n)]) for i, n in enumerate([0, 1, 6, 7, 8, 14, 15, 100, 251, 252, 253, 700])] * 2
    lines = spark.createDataFrame(rows, "k int, h array<long>").withColumn("want", line_dedup.simhash("h"))
    got = line_dedup.with_bits(lines, "h")
    assert got.columns == ["k", "want", "_bits"]
    assert got.count() == len(rows) and got.where(F.col("want") != F.col("_bits")).isEmpty()


def test_simhash_by_hand(spark):
    """Majority bits of distinct words: few, more than a lane counts, and more than a slice holds."""
    import xxhash

    rng = random.Random(11)
    lines = [" ".join(f"w{rng.randrange(10**7)}" for _ in range(n)) for n in (1, 2, 3, 6, 7, 8, 15, 251, 252, 253, 600, 5000)] + ["alpha " * 69_999 + "beta"]
    got = _described(spark, lines)
    for line, (bits, _) in zip(lines, got, strict=True):
        hashes = {xxhash.xxh64_intdigest(w.encode(), 42) for w in line.split()}
        assert bits == sum(1 << b for b in range(63) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_lines_with_clashing_columns_nulls_and_ties(spark):
    """Columns of the operator's own names, null keys, rows repeated exactly, a very long line; each has its stated result."""
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(5, "a b\nc", "x", 1, 2, 3.0), (5, "a b\nc", "x", 1, 2, 3.0), (None, "a b", "y", None, None, None), (7, long, "", 0, 0, 0.0), (8, long + " more", "", 0, 0, 0.0), (9, None, None, 1, 1, 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row string, n_lines int, _doc int, _key double")
    out = line_dedup.line_dedup(docs)
    assert sorted(out.columns) == sorted([*docs.columns, "n_removed", "removed"])
    got = sorted(((r["doc_id"], r["text"], r["n_lines"], list(r["removed"])) for r in out.collect()), key=str)
    assert got == sorted([(5, "a b\nc", 2, []), (5, "a b\nc", 2, []), (None, "", 1, [0]), (7, long, 1, []), (8, "", 1, [0]), (9, None, 0, [])], key=str)


def _signed(x):
    return x - 2**64 if x >= 2**63 else x


def _prints_by_force(rows, low, high):
    """{(key, text): (edited digest, fingerprint, edited fingerprint, near_edited, near_next)}"""
    import math
    import re
    import struct

    import xxhash

    def of_long(v, seed):
        return xxhash.xxh64_intdigest(struct.pack("<q", v), seed % 2**64)

    def of_int(v, seed):
        return xxhash.xxh64_intdigest(struct.pack("<i", v), seed % 2**64)

    def terms(text):
        return {_signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in re.split(r"[^\w]|_", text.lower()) if w}

    df = {}
    for _, text in rows:
        for t in terms(text or ""):
            df[t] = df.get(t, 0) + 1
    words = {t for t, n in df.items() if max(2, low * len(rows)) <= n <= high * len(rows)}

    def depth(t, s):
        h = of_int(s, of_long(t, 42)) & (2**31 - 1)
        return 31 if h == 0 else (h & -h).bit_length() - 1

    def printed(text):
        own = sorted(terms(text) & words)
        first = max(0, int(math.log2(len(own))) - imatch.DENSER) if own else 0
        out = []
        for s in range(imatch.SUBSETS):
            for level in range(first, first + imatch.LEVELS):
                h, some = 42, False
                for t in own:
                    if depth(t, s) > level:
                        h, some = of_long(t, h), True
                out.append(f"{h & 65535:04x}" if some else "....")
        bare = f"{xxhash.xxh64_intdigest(text.encode(), 42):016x}"
        return first, out, f"{first:02d}" + "".join(out) if own else bare

    def likeness(p, q):
        if p[2] == q[2]:
            return 1.0
        some = equal = 0
        for level in range(max(p[0], q[0]), min(p[0], q[0]) + imatch.LEVELS):
            a = [p[1][s * imatch.LEVELS + level - p[0]] for s in range(imatch.SUBSETS)]
            b = [q[1][s * imatch.LEVELS + level - q[0]] for s in range(imatch.SUBSETS)]
            here = [(x, y) for x, y in zip(a, b) if (x, y) != ("....", "....")]
            same = sum(x == y for x, y in here)
            some, equal = (len(here), same) if 2 * len(here) >= imatch.SUBSETS else (some + len(here), equal + same)
        return equal / some if some else 0.0

    name = lambda key, text: _signed(xxhash.xxh64_intdigest(b"\x01\0\0\0" if key is None else b"\0\0\0\0", xxhash.xxh64_intdigest(text.encode(), 42)))
    ordered = sorted({(k, t or "") for k, t in rows}, key=lambda r: (r[0] is None, r[0] or 0, name(*r)))
    out = {}
    for i, (key, text) in enumerate(ordered):
        after = ordered[(i + 1) % len(ordered)][1]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        own, other, following = printed(text), printed(edited), printed(after)
        out[key, text] = (hashlib.sha256(edited.encode()).hexdigest(), own[2], other[2], likeness(own, other), likeness(own, following))
    return out


def test_fingerprints_by_force(make, monkeypatch):
    """Digests, fingerprints and likeness of every row: ids over the whole range of longs, null and repeated ids, ties, empty texts, texts without lexicon terms, short and long ones."""
    monkeypatch.setattr(imatch, "LOW", 0.0)
    rng = random.Random(3)
    vocabulary = [f"term{i}" for i in range(3000)]
    rows = [(i * 7, " ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 9, 40, 150, 400, 2500])))) for i in range(60)]
    rows += [(500, rows[5][1]), (501, None), (502, ""), (503, "?!"), (504, "été" * 3), (505, "one two"), (505, "one two"), (505, rows[7][1])]
    rows += [(-(2**63), rows[9][1] + " end"), (2**63 - 1, "term1 term2"), (None, "term1 term2"), (None, rows[11][1]), (None, None)]
    got = imatch.fingerprints(make(rows)).collect()
    want = _prints_by_force(rows, imatch.LOW, imatch.HIGH)
    assert len(got) == len(rows)
    texts = {(k, v[0]): t for (k, t), v in want.items()}
    for r in got:
        text = texts[r["doc_id"], r["edited"]]
        assert r["n_chars"] == len(text)
        found = (r["edited"], r["fingerprint"], r["edited_fingerprint"], r["near_edited"], r["near_next"])
        assert found[:3] == want[r["doc_id"], text][:3]
        assert found[3:] == pytest.approx(want[r["doc_id"], text][3:])
    assert {(k, t or "") for k, t in rows} == {(r["doc_id"], texts[r["doc_id"], r["edited"]]) for r in got}
    of = {r["doc_id"]: r for r in got}
    assert of[35]["fingerprint"] == of[500]["fingerprint"]
    usual = [r for r in got if (r["doc_id"] or -1) in range(420)]
    assert sum(r["near_edited"] for r in usual) > 3 * sum(r["near_next"] for r in usual)
    assert of[502]["fingerprint"] == of[501]["fingerprint"] != of[503]["fingerprint"]
    assert imatch.fingerprints(make([])).count() == 0
    alone = imatch.fingerprints(make([(1, "abcdefgh")])).first()
    assert alone["edited"] == hashlib.sha256(b"abcdefab").hexdigest()


@pytest.mark.parametrize("rows", [[(1, "a b")], [(None, "a"), (None, None)], [(-5, "x"), (10**12, "y"), (3, "z")], [(-(2**63), "p"), (0, "q"), (2**63 - 1, "r")]])
def test_neighbours_of_few_rows(make, rows):
    got = imatch.fingerprints(make(rows)).collect()
    assert {(r["doc_id"], r["edited"]) for r in got} == {(k, v[0]) for (k, _), v in _prints_by_force(rows, 0, 1).items()}


def test_fingerprints_beside_clashing_columns(spark):
    rows = [(1, "one two three", 5, "x"), (2, "one two four", 6, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int, k1 string")
    assert sorted(r["n_chars"] for r in imatch.fingerprints(docs).collect()) == [12, 13]
