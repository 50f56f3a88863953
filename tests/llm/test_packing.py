import random
import zlib

import brute
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sparkloom.llm import kernels as K
from sparkloom.llm import packing

TEXTS = ["", " ", "a  b", "a \n b", "x ", " x", "it's we'll don't", "<|endoftext|> a", "a <|endoftext|> b", "x<|endoftext|><|endoftext|>", "<|endof text|>", "é  b", "tab\t x", "naïve café\nÀ Ça va", "日本語 text", "x" * 5000, "1234 5,6.7 !!! ??", "a\n\nb c", "\u00a0nbsp here", "emoji 🙂 ok", "word " * 3000]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_ids_equal_the_tokenizers(tokenizer):
    import pyarrow as pa

    rng = random.Random(1)
    letters = "abcdefghij éüñ,.\n  '!12"
    texts = TEXTS + ["".join(rng.choice(letters) for _ in range(rng.randrange(200))) for _ in range(300)]
    encoder = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    ids, first = encoder.encode(*K.utf8(pa.array(texts)))
    for i, text in enumerate(texts):
        assert ids[first[i] : first[i + 1]].tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text[:50]


def test_plan_is_best_fit_decreasing():
    for trial in range(300):
        rng = random.Random(trial)
        capacity = rng.choice([7, 10, 64])
        sizes = [rng.randint(1, capacity) for _ in range(rng.randrange(150))]
        counts = {s: sizes.count(s) for s in set(sizes)}
        bins, seen = {}, set()
        for length, rank, ranks, first, each, offset in packing.best_fit_decreasing(counts, capacity):
            for j in range(ranks):
                seen.add((length, rank + j))
                bins.setdefault(first + j // each, []).append((offset + j % each * length, length))
        assert len(seen) == len(sizes) and len(bins) == brute.best_fit_bins(sizes, capacity)
        for parts in bins.values():
            end = 0
            for offset, length in sorted(parts):
                assert offset == end
                end += length
            assert end <= capacity


def test_pack_round_trip(make, tokenizer):
    rng = random.Random(2)
    rows = [(i, t) for i, t in enumerate(TEXTS + [" ".join(rng.choice(["alpha", "beta", "gamma,"]) for _ in range(rng.randrange(900))) for _ in range(60)])] + [(99, None), (3, TEXTS[3]), (None, "no key")]
    got = packing.pack(make(rows)).collect()
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
    want, sizes = [], []
    for key, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        start, piece = 0, 0
        for n in [len(ids) % 2048 or 2048] + [2048] * ((len(ids) - 1) // 2048):
            want.append((-1 if key is None else key, piece, start, n, zlib.crc32(ids[start : start + n].tobytes())))
            sizes.append(n)
            start, piece = start + n, piece + 1
    assert sorted((-1 if r[0] is None else r[0], *r[1:5]) for r in map(tuple, got)) == sorted(want)
    assert len(bins) == brute.best_fit_bins(sizes, 2048)
    assert packing.pack(make([])).count() == 0


def test_special_tokens_have_their_ids(tokenizer):
    import pyarrow as pa

    encoder = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    ids, _ = encoder.encode(*K.utf8(pa.array(["a <|endoftext|> b"])))
    assert ids.tolist() == tokenizer.encode("a <|endoftext|> b", add_special_tokens=False).ids
    assert 50256 in ids.tolist()


def test_long_texts_are_cut_without_a_change(make, tokenizer, monkeypatch):
    """Stretches of 64 bytes: the ids of whole texts, plain, mixed and without a place to cut."""
    monkeypatch.setattr(packing, "CHUNK", 64)
    rng = random.Random(5)
    letters = "abcdefghij éü\u00a0,.\n  '!12日本"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(900))) for _ in range(120)] + ["x" * 500, "ab " * 300, "日本" * 200, "日本" * 100 + " a b" * 50, "a <|endoftext|> b " * 30]
    for text in texts:
        raw = np.frombuffer(text.encode(), np.uint8)
        places = [0, *packing.cut_places(raw, 64), len(raw)]
        ids = [i for a, b in zip(places, places[1:]) for i in tokenizer.encode(raw[a:b].tobytes().decode(), add_special_tokens=False).ids]
        assert ids == tokenizer.encode(text, add_special_tokens=False).ids
    want = []
    for i, text in enumerate(texts):
        own = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 0], "<u4")
        want.append((i, 0, 0, len(own), zlib.crc32(own.tobytes())))
    got = []
    docs = make(list(enumerate(texts)))
    for batch in docs.select("doc_id", "text").toArrow().to_batches():
        got += [tuple(r.values()) for out in _run(docs)([batch]) for r in out.to_pylist()]
    assert sorted(got) == sorted(want)


def _run(docs):
    """The function that ``pieces`` gives to mapInArrow, to be called in this process."""
    held = {}

    class Frame:
        sparkSession = docs.sparkSession

        def select(self, *columns):
            made = docs.select(*columns)
            held.setdefault("chosen", made)
            return Caught(made)

    class Caught:
        def __init__(self, made):
            self.made = made

        def select(self, *columns):
            return self.made.select(*columns)

        def mapInArrow(self, run, schema):
            held["run"] = run

    packing.pieces(Frame())
    return held["run"]


def test_keys_named_as_results_and_ties(make, spark):
    """A key column called length; extra columns that clash; many equal pieces; rows repeated exactly."""
    rows = [(i % 3, "word " * 40, i, "x") for i in range(50)] + [(None, None, 0, None), (7, "", 1, "")]
    docs = spark.createDataFrame(rows, "length long, text string, piece int, _key string").repartition(3)
    got = packing.pack(docs, key="length").collect()
    assert len(got) == len(rows)
    assert sorted(r["length"] for r in got if r["length"] is not None) == sorted(r[0] for r in rows if r[0] is not None)
    assert {"length", "length_", "sequence_id", "offset"} <= set(got[0].asDict())
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length_"]))
    for parts in bins.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(bins) == brute.best_fit_bins([r["length_"] for r in got], 2048)


def test_numbering_in_several_parts(make, monkeypatch):
    """Ranks of one length that are dealt over salts, and a plan over several blocks, fill sequences as tightly."""
    monkeypatch.setattr(packing, "NUMBERED", 7)
    monkeypatch.setattr(packing, "RANKS", 3)
    rows = [(i, "word " * (40 if i % 3 else 100 + i % 5)) for i in range(400)] + [(1000 + i, "word " * 4000) for i in range(5)]
    got = packing.pack(make(rows), capacity=256).collect()
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 256
    assert len(bins) == brute.best_fit_bins([r["length"] for r in got], 256)
