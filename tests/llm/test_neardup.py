import random

import numpy as np
import pytest
from plain import DOCS, by_id, documents, near_classes

from marginalia.llm import neardup
from marginalia.llm.components import components


def family(rng, n, words, change):
    base = [f"w{rng.randrange(900)}" for _ in range(words)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randrange(change + 1)):
            own[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(own))
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    texts = family(rng, 60, 120, 9) + family(rng, 40, 60, 5) + family(rng, 30, 40, 2) + [" ".join(f"u{rng.randrange(5000)}" for _ in range(50)) for _ in range(30)]
    texts += [texts[3]] * 20 + [texts[3].upper(), "one", "ONE", "", " \t\n", None, "a b", "b a", "a b", "Ä b", "ä b"]
    rng.shuffle(texts)
    return dict(enumerate(texts))


@pytest.mark.parametrize(("words", "small", "block"), [(2, 24, 1000), (2, 2, 7), (5, 24, 1000), (5, 3, 4)])
def test_same_classes_as_all_pairs(spark, corpus, monkeypatch, words, small, block):
    monkeypatch.setattr(neardup, "SMALL", small)
    monkeypatch.setattr(neardup, "BLOCK", block)
    got = by_id(neardup.near_duplicates(documents(spark, corpus), words))
    want = near_classes(corpus, words)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())


def test_large_buckets_are_settled_in_tasks(spark, monkeypatch):
    """A chain of families whose members are only just similar: stars alone don't join them."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(100)]
    texts = {}
    for i in range(80):
        own = list(base)
        for k in range(i % 20, i % 20 + 6):
            own[(5 * k) % 100] = f"y{i % 20}_{k}_{rng.randrange(2)}"
        texts[i] = " ".join(own)
    monkeypatch.setattr(neardup, "SMALL", 2)
    monkeypatch.setattr(neardup, "BLOCK", 10)
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", 1000)
    got = by_id(neardup.near_duplicates(documents(spark, texts), 2))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == near_classes(texts, 2)


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    got = by_id(neardup.near_duplicates(docs, 2))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == near_classes(texts, 2)


def test_nulls_repeats_and_empty_tables(spark):
    rows = [(1, "same words here", None, None, None), (1, "same words here", None, None, None), (None, "same words here", None, None, None), (5, "same words here", None, None, None), (7, None, None, None, None)]
    docs = spark.createDataFrame(rows, DOCS).withColumnsRenamed({"lang": "digest", "source": "component_id"})
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(docs, 2).collect()), key=repr)
    assert got == [(1, 2, 1), (1, 2, 1), (5, 2, 1), (7, 0, 7), (None, 2, None)]
    assert neardup.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_pruning_keeps_what_is_similar():
    """Of pairs at 0.8, fewer than one in a thousand are dropped; far pairs go early."""
    rng = np.random.default_rng(1)
    needed = neardup.least_matches()
    a = rng.integers(0, 60000, (4000, neardup.HASHES), dtype=np.uint16)
    near = np.where(rng.random(a.shape) < 0.8, a, a + 1)
    far = np.where(rng.random(a.shape) < 0.3, a, a + 1)
    assert len(neardup.likely(a, near, needed)) > 3996
    assert len(neardup.likely(a, far, needed)) == 0


def test_bands_share_a_key_exactly_where_stored_rows_agree():
    """Signatures that agree in the 16 bits kept but not in the 32 bits drawn share the bucket that _facing names."""
    rng = np.random.default_rng(6)
    a = rng.integers(0, 2**16, neardup.HASHES, dtype=np.uint32)
    b = a.copy()
    b[: neardup.ROWS] += 1 << 16  # the first band: equal in the low bits alone
    b[2 * neardup.ROWS :] = rng.integers(0, 2**16, neardup.HASHES - 2 * neardup.ROWS)
    a, b = a.astype("<u2"), b.astype("<u2")
    same = (a == b).reshape(neardup.BANDS, neardup.ROWS).all(axis=1)
    assert same[:2].all() and (same == (neardup.band_keys(a) == neardup.band_keys(b))).all()


def test_a_pair_whose_first_bands_agree_in_the_kept_bits_alone_is_linked(spark, monkeypatch):
    """Minima that differ by a multiple of 2**16 look alike in storage; no link is lost over it, large buckets included."""
    drawn = neardup.signature
    monkeypatch.setattr(neardup, "signature", lambda members: drawn(members) % 3)  # nearly all stored rows agree somewhere
    monkeypatch.setattr(neardup, "SMALL", 2)
    rng = random.Random(12)
    texts = dict(enumerate(family(rng, 30, 50, 6) + family(rng, 12, 30, 3)))
    stored = neardup.sketches(documents(spark, texts), 2).first()["sig"]
    assert max(np.frombuffer(stored, "<u2")) < 3  # the change has reached the workers
    got = by_id(neardup.near_duplicates(documents(spark, texts), 2))
    assert {i: r["component_id"] for i, r in got.items()} == {i: c for i, (_, c) in near_classes(texts, 2).items()}


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(0, 60)] + [(100, x) for x in range(101, 160)] + [(7, 7), (None, 3), (201, 200), (200, 201)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 160)} | {200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).isEmpty()
