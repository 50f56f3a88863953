import random

from sparkloom.llm import imatch


def test_long_texts_are_like_their_edits(make):
    """Texts of over 5,000 lexicon terms: an edit of a quarter leaves part of the hashes, another text next to none."""
    rng = random.Random(6)
    vocabulary = [f"term{i:05d}" for i in range(24_000)]
    rows = [(i, " ".join(rng.sample(vocabulary, 6000))) for i in range(8)]
    rows += [(100 + i, " ".join(rng.sample(vocabulary, 200))) for i in range(60)]
    docs = make(rows)
    got = {r["doc_id"]: r for r in imatch.fingerprints(docs).collect()}
    edited = sum(got[i]["near_edited"] for i in range(8)) / 8
    following = sum(got[i]["near_next"] for i in range(7)) / 7
    assert edited > 0.25 and edited > 2 * following
