import random

import brute
import pytest

from sparkloom.llm import jaccard_join, substring_dedup, suffix_index


def words(rng, n, vocabulary=4000):
    return [f"w{rng.randrange(vocabulary)}é" if rng.random() < 0.1 else f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def edited(rng, base, share):
    return [rng.choice(["new", f"x{rng.randrange(10**6)}"]) if rng.random() < share else w for w in base]


def corpus(seed):
    """Unique texts, exact copies, near copies, shared passages, short, empty and null ones; a row that repeats."""
    rng = random.Random(seed)
    base, line = words(rng, 160), words(rng, 70)
    texts = [" ".join(words(rng, rng.randrange(1, 200))) for _ in range(25)]
    texts += [" ".join(base)] * 6 + [" ".join(edited(rng, base, s)) for s in (0.005, 0.01, 0.02, 0.03, 0.05, 0.1) for _ in range(5)]
    texts += [" ".join([*words(rng, 30), *line, *words(rng, 20)]) for _ in range(12)]
    texts += ["One", "one", "one two", "ONE two", "", None, "  \n\t ", "a b c", "a b c d", " ".join(words(rng, 5000))]
    rng.shuffle(texts)
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    return [*rows, rows[4], (None, " ".join(base)), (None, "alone here now")]


@pytest.mark.parametrize(("width", "num", "den", "seed"), [(3, 9, 10, 1), (5, 4, 5, 2)])
def test_join_matches_all_pairs(make, width, num, den, seed):
    rows = corpus(seed)
    got = jaccard_join.jaccard_join(make(rows), width=width, num=num, den=den).collect()
    want = [(k, *x) for (k, _), x in zip(rows, brute.joined(rows, width, num, den), strict=True)]
    none_last = lambda r: tuple((v is None, v or 0) for v in r)
    assert sorted((tuple(r) for r in got), key=none_last) == sorted(want, key=none_last)


def test_join_of_large_groups_in_blocks(make, monkeypatch):
    """Several blocks, fragments and stretches of columns: partial overlaps of every pair are summed."""
    monkeypatch.setattr(jaccard_join, "BLOCK_CLASSES", 8)
    monkeypatch.setattr(jaccard_join, "FRAGMENT_GRAMS", 700)
    monkeypatch.setattr(jaccard_join, "COLUMNS", 16)
    rng = random.Random(5)
    base = words(rng, 120)
    rows = [(i, " ".join(edited(rng, base, 0.012))) for i in range(40)]
    got = {r[0]: tuple(r)[1:] for r in jaccard_join.jaccard_join(make(rows), width=3, num=9, den=10).collect()}
    assert [got[k] for k, _ in rows] == brute.joined(rows, 3, 9, 10)


def test_join_of_nothing_and_clashing_columns(make, spark):
    assert jaccard_join.jaccard_join(make([])).count() == 0
    df = spark.createDataFrame([(1, "a b c d e f", "x", 2), (2, "a b c d e f", "y", 3)], "doc_id long, text string, cid string, n int")
    assert sorted(tuple(r) for r in jaccard_join.jaccard_join(df).collect()) == [(1, 2, 1, 1), (2, 2, 1, 1)]


def check_bytes(rows, got, size):
    want = brute.covered([(k, (t or "").encode()) for k, t in rows], size)
    expected = sorted((k if k is not None else -1, len((t or "").encode()), len(w), brute.runs(w), bytes(b for i, b in enumerate((t or "").encode()) if i not in w)) for (k, t), w in zip(rows, want, strict=True))
    assert sorted((r[0] if r[0] is not None else -1, r["n_bytes"], sum(s["stop"] - s["start"] for s in r["spans"]), len(r["spans"]), bytes(r["kept"])) for r in got) == expected


@pytest.mark.parametrize("hot", [20_000, 2])
def test_repeated_bytes(make, hot):
    rows = corpus(3)
    check_bytes(rows, suffix_index.repeated_bytes(make(rows), hot_texts=hot).collect(), 50)


def test_repeated_bytes_of_monotonous_texts(make):
    rows = [(1, "a" * 300), (2, "a" * 120 + "b" * 60), (3, "b" * 59), (4, "ab" * 100), (5, "ba" * 30), (6, "\x00" * 70), (7, "\x00" * 55 + "x"), (8, "a" * 49), (9, "é" * 40), (10, "é" * 25 + "z")]
    check_bytes(rows, suffix_index.repeated_bytes(make(rows)).collect(), 50)


def test_levels_merge_geometrically():
    import numpy as np

    rng, levels, first = np.random.default_rng(1), suffix_index.Levels(), {}
    for batch in range(40):
        keys = rng.integers(0, 300, 50).astype("S5")
        docs = np.sort(rng.integers(batch * 10, batch * 10 + 10, 50))
        got = levels.add(keys, docs)
        for k, d in zip(keys, docs, strict=True):
            first[k] = min(first.get(k, d), d)
        assert list(got) == [first[k] for k in keys]
        sizes = [len(a) for a, _ in levels.arrays]
        assert all(a >= 2 * b for a, b in zip(sizes, sizes[1:], strict=False))


def check_words(rows, got, size):
    split = [(k, tuple(brute.WORD.findall(t or ""))) for k, t in rows]
    want = brute.covered(split, size)
    expected = sorted((k if k is not None else -1, len(s), len(w), " ".join(x for i, x in enumerate(s) if i not in w)) for (k, s), w in zip(split, want, strict=True))
    assert sorted((r[0] if r[0] is not None else -1, r["n_words"], sum(s["stop"] - s["start"] for s in r["spans"]), r["kept"]) for r in got) == expected


@pytest.mark.parametrize(("size", "hot"), [(50, 20_000), (50, 2), (25, 20_000)])
def test_repeated_words(make, size, hot):
    rows = corpus(4)
    check_words(rows, substring_dedup.repeated_words(make(rows), size=size, gram=20 if size == 50 else 10, hot_texts=hot).collect(), size)


def test_repeats_of_nothing_and_one_key(make):
    assert suffix_index.repeated_bytes(make([])).count() == 0
    assert substring_dedup.repeated_words(make([])).count() == 0
    text = " ".join(f"t{i}" for i in range(80))
    rows = [(1, text), (1, text), (1, "x " + text), (2, text + " y")]
    got = sorted((r["doc_id"], r["kept"]) for r in substring_dedup.repeated_words(make(rows)).collect())
    assert got == [(1, text), (1, text), (1, "x " + text), (2, "y")]
    check_bytes(rows, suffix_index.repeated_bytes(make(rows)).collect(), 50)


@pytest.mark.parametrize(("num", "den"), [(9, 10), (4, 5), (1, 2)])
def test_similar_sets_share_a_fragment(num, den):
    import numpy as np

    rng = np.random.default_rng(num)
    for _ in range(600):
        n = int(rng.integers(1, 250))
        x = rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2)
        keep = rng.random(n) > rng.random() * (1 - num / den)
        y = np.unique(np.concatenate([x[keep], rng.integers(0, 1 << 63, int(rng.integers(0, 1 + n // 8))).astype(np.uint64)]))
        x = np.unique(x)
        both = len(np.intersect1d(x, y))
        if len(y) and both * den >= num * (len(x) + len(y) - both):
            mark, row = jaccard_join.signatures(np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)]), num, den)
            assert len(np.intersect1d(mark[row == 0], mark[row == 1]))


def test_deep_nodes_by_force():
    import numpy as np

    rng = random.Random(31)
    for depth in (1, 2, 3, 5, 8, 50):
        sequences = [[rng.randrange(3) for _ in range(rng.randrange(0, 70))] for _ in range(12)]
        sequences += [sequences[0], sequences[1][3:], [7] * 60]
        first = np.concatenate([[0], np.cumsum([len(x) for x in sequences])])
        place, node = substring_dedup.deep_nodes(np.array([y for x in sequences for y in x], np.int64), first, depth)
        windows = {}
        for i, x in enumerate(sequences):
            for j in range(len(x) - depth + 1):
                windows.setdefault(tuple(x[j : j + depth]), []).append(int(first[i]) + j)
        want = sorted(sorted(v) for v in windows.values() if len(v) > 1)
        got = {}
        for p, n in zip(place.tolist(), node.tolist()):
            got.setdefault(n, []).append(p)
        assert sorted(sorted(v) for v in got.values()) == want


def test_hashes_propose_and_bytes_confirm(monkeypatch):
    """Words, and runs, of one hash are told apart by their bytes."""
    import numpy as np

    from sparkloom.llm import kernels as K

    raw = np.frombuffer(b"ab cd ab ef cd abc", np.uint8)
    starts, ends, _ = K.words(raw, np.array([0, len(raw)]))
    monkeypatch.setattr(K, "word_hashes", lambda data, starts, ends: np.zeros(len(starts), np.uint64))
    rank = K.exact_ranks(raw, starts, ends)
    words_of = ["ab", "cd", "ab", "ef", "cd", "abc"]
    assert all((rank[i] == rank[j]) == (words_of[i] == words_of[j]) for i in range(6) for j in range(6))
    monkeypatch.setattr(K, "CHUNK", 4)
    assert K.same_bytes(raw, starts[[0, 0, 0, 1, 0]], ends[[0, 0, 0, 1, 0]], starts[[2, 3, 5, 4, 0]], ends[[2, 3, 5, 4, 0]]).tolist() == [True, False, False, True, True]


@pytest.mark.parametrize("held", [0, 1 << 30])
def test_groups_closed_at_any_size(make, monkeypatch, held):
    """Subtrees of one group at a time or of all; anchors that count as very common, with many equal windows."""
    monkeypatch.setattr(substring_dedup, "HELD", held)
    rng = random.Random(32)
    passage = words(rng, 30)
    rows = [(i, " ".join([*words(rng, 5), *passage, *words(rng, 5)])) for i in range(30)]
    for hot in (3, 20_000):
        check_words(rows, substring_dedup.repeated_words(make(rows), size=12, gram=5, hot_texts=hot).collect(), 12)


def test_repeats_beside_clashing_columns(spark):
    text = " ".join(f"w{i}" for i in range(80))
    docs = spark.createDataFrame([(1, text, "a", 5), (2, text, "b", None), (None, text, None, None)], "doc_id long, text string, spans string, doc int")
    assert sorted((r["doc_id"] or 9, sum(s["stop"] - s["start"] for s in r["spans"])) for r in substring_dedup.repeated_words(docs).collect()) == [(1, 0), (2, 80), (9, 0)]
    assert sorted((r["doc_id"] or 9, sum(s["stop"] - s["start"] for s in r["spans"])) for r in suffix_index.repeated_bytes(docs).collect()) == [(1, 0), (2, len(text)), (9, 0)]
