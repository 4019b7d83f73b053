import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from plain import DOCS, WORD, by_id, documents

from marginalia.llm import mixing, packing


def plain_targets(sizes):
    names = sorted((n for n in sizes if n is not None)) + [None] * (None in sizes)
    weight = {n: i % 3 + 1 for i, n in enumerate(names)}
    left, free, out = float(sum(sizes.values())), set(names), {}
    while free:
        rate = left / sum(weight[n] for n in free)
        over = [n for n in free if rate * weight[n] > 3 * sizes[n]]
        if not over:
            return out | {n: rate * weight[n] for n in free}
        for n in over:
            out[n] = 3.0 * sizes[n]
            left -= out[n]
            free.discard(n)
    return out


def test_mix_over_a_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    got = by_id(mixing.mix(docs))
    assert got.keys() == rows.keys()
    sizes = {}
    for i, r in rows.items():
        n = len(WORD.findall(r["text"] or ""))
        assert got[i]["size"] == n and 0 <= got[i]["taken"] <= 3 * n
        sizes[r["source"]] = sizes.get(r["source"], 0) + n
    want = plain_targets(sizes)
    for s in sizes:
        own = [g for i, g in got.items() if rows[i]["source"] == s]
        assert {g["source_size"] for g in own} == {sizes[s]} and own[0]["target"] == pytest.approx(want[s])
        assert abs(sum(g["taken"] for g in own) - want[s]) <= max(32, 0.02 * want[s])
    assert {i: g["taken"] for i, g in got.items()} == {i: g["taken"] for i, g in by_id(mixing.mix(docs.repartition(5))).items()}


def test_mix_of_odd_tables(spark):
    texts = ["a b c"] * 4 + ["", None] + [" ".join("x" * 200)] * 6 + ["one"]
    docs = documents(spark, texts, {0: None, 1: None, 4: "empty", 5: "empty", 12: "tiny"}).withColumnRenamed("lang", "target")
    got = by_id(mixing.mix(docs))
    want = plain_targets({None: 6, "empty": 0, "tiny": 1, "src0": sum(len((texts[i] or "").split()) for i in (3, 6, 9)), "src1": 400, "src2": 400 + 3})
    assert len(got) == 13 and all(got[i]["target"] == 0 and got[i]["taken"] == 0 for i in (4, 5))
    assert got[0]["target"] == pytest.approx(want[None]) and got[12]["target"] == pytest.approx(want["tiny"])
    assert mixing.mix(spark.createDataFrame([], DOCS)).isEmpty()
    assert mixing.mix(documents(spark, ["", None])).agg({"taken": "sum"}).first()[0] == 0


def test_mixed_texts_hold_the_words_taken(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    plan = by_id(mixing.mix(docs))
    taken, texts = {}, {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in mixing.apply_mix(docs).collect():
        words = WORD.findall(r["text"])
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + len(words)
        assert set(words) <= set(WORD.findall(texts[r["doc_id"]])) and r["n_chars"] == len(r["text"])
    assert taken == {i: p["taken"] for i, p in plan.items() if p["taken"]}


def test_repeated_and_null_ids_are_mixed_row_by_row(spark):
    rng = np.random.default_rng(4)
    sources = [None, "a", "b", "c"]
    rows = [(None if i % 3 == 0 else i // 6, " ".join(f"r{i}w{k}" for k in range(int(rng.integers(1, 90)))), "en", sources[i % 4], 0) for i in range(240)]
    rows += [(7, "s one two three", "en", "a", 0)] * 5  # exact copies
    docs = spark.createDataFrame(rows, DOCS)
    plan = mixing.mix(docs).collect()
    want, got, runs = {}, {}, {}
    for r in plan:
        want[r["doc_id"], r["source"]] = want.get((r["doc_id"], r["source"]), 0) + r["taken"]
    for r in mixing.apply_mix(docs).collect():
        words = r["text"].split()
        got[r["doc_id"], r["source"]] = got.get((r["doc_id"], r["source"]), 0) + len(words)
        runs.setdefault((r["doc_id"], r["source"]), set()).update(words)
    assert got == {k: n for k, n in want.items() if n}
    texts = {}
    for i, t, _, s, _ in rows:
        texts.setdefault((i, s), set()).update(t.split())
    assert all(w <= texts[k] for k, w in runs.items())


def test_sainte_lague_deals_the_highest_quotients(spark):
    weights = {"a": 53.0, "b": 24.0, "c": 23.0, "d": 0.0, "e": 7.5}
    parties = spark.createDataFrame([(1, k, w, 40, 40) for k, w in weights.items()], "g int, k string, w double, seats int, cap int")
    got = {r["k"]: r["quota"] for r in mixing.sainte_lague(parties, ["g"], ["k"], "w", "seats", "cap").collect()}
    held = dict.fromkeys(weights, 0)
    for _ in range(40):
        best = max(weights, key=lambda k: weights[k] / (2 * held[k] + 1))
        held[best] += 1
    assert got == held


def placed(segments, histogram, capacity):
    bins, ranks = {}, {}
    for length, first, end, first_bin, each, offset in segments:
        for rank in range(first, end):
            assert rank not in ranks.setdefault(length, set())
            ranks[length].add(rank)
            at = rank - first
            bins.setdefault(first_bin + at // each, []).append((offset + at % each * length, length))
    assert {x: len(r) for x, r in ranks.items()} == {x: n for x, n in histogram.items() if n}
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 9), max_size=14))
def test_plan_fills_sequences_without_gaps(histogram):
    total = sum(x * n for x, n in histogram.items())
    bins = placed(packing.plan(histogram, 40), histogram, 40)
    assert bins >= -(-total // 40)
    rooms = []  # plain best-fit decreasing never is better
    for x in sorted((x for x, n in histogram.items() for _ in range(n)), reverse=True):
        fit = min((r for r in rooms if r >= x), default=None)
        if fit is None:
            rooms.append(40 - x)
        else:
            rooms.remove(fit)
            rooms.append(fit - x)
    assert bins <= len(rooms)


@settings(max_examples=500, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 3), min_size=1, max_size=9), st.integers(0, 60), st.randoms(use_true_random=False))
def test_best_pair_is_the_best_of_all_pairs(counts, room, rng):
    live = sorted(counts)
    x = rng.choice(live)
    have = {y: n - (y == x) for y, n in counts.items()}
    want = max((a + b for i, a in enumerate(live) for b in live[i:] if a + b <= room and have[a] and have[b] and (a != b or have[a] > 1)), default=0)
    assert packing.best_pair(live, counts, x, room) == want


def test_pairs_and_plans_that_once_were_wrong():
    assert packing.best_pair([5, 11], {5: 2, 11: 1}, 11, 29) == 10
    assert placed(packing.plan({11: 1, 5: 2}, 40), {11: 1, 5: 2}, 40) == 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(2, 12), min_size=1, max_size=8))
def test_reduction_keeps_an_optimal_packing(pieces):
    def fewest(items, rooms):
        if not items:
            return len(rooms)
        best = 99
        for k in sorted(set(rooms)):
            if k >= items[0]:
                rest = list(rooms)
                rest.remove(k)
                best = min(best, fewest(items[1:], [*rest, k - items[0]]))
        return min(best, fewest(items[1:], [*rooms, 12 - items[0]]))

    counts = {x: pieces.count(x) for x in pieces}
    fixed = packing.reduce_dominated(counts, 12)
    rest = sorted((x for x, n in counts.items() for _ in range(n)), reverse=True)
    assert sum(times for _, times in fixed) + fewest(rest, []) == fewest(sorted(pieces, reverse=True), [])


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))


TRICKY = st.text(alphabet=st.sampled_from("aBé1.,'!?-<|>  ́ßIİ\t\n 日\U0001f600"), max_size=40)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(TRICKY, st.text(max_size=30), st.sampled_from(["<|endoftext|> x", "don't I'LL we've", "A<|startoftext|>b.", "\u0130<", "\u0130. x", "E\u0301.", "\u039f\u03a3."])), min_size=1, max_size=6))
def test_words_give_the_ids_of_their_text(tokenizer, texts):
    import public_tokenizers

    known = packing.WordIds(public_tokenizers.path(packing.TOKENIZER))
    parts = [t.encode().split() for t in texts]
    known.learn(set().union(*parts))
    for text, words in zip(texts, parts, strict=True):
        ids = np.frombuffer(b"".join(known[w] for w in words), "<u4").tolist()
        assert ids == tokenizer.encode(text, add_special_tokens=False).ids


class Watched:
    """A tokenizer that notes the texts which it encodes."""

    def __init__(self, tokenizer) -> None:
        self.tokenizer, self.seen = tokenizer, []

    def encode(self, text, **more):
        self.seen += text.split()
        return self.tokenizer.encode(text, **more)


@pytest.fixture(scope="module")
def word_ids():
    import public_tokenizers

    return packing.WordIds(public_tokenizers.path(packing.TOKENIZER))


LETTERS = "".join(c for c in map(chr, range(0x41, 0x180)) if c.isalpha())


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(LETTERS + ".,-"), min_size=1, max_size=12), min_size=1, max_size=6))
def test_words_of_letters_give_the_ids_of_their_text(tokenizer, word_ids, words):
    word_ids.learn({w.encode() for w in words})
    for w in words:
        assert np.frombuffer(word_ids[w.encode()], "<u4").tolist() == tokenizer.encode(w, add_special_tokens=False).ids


def test_plain_words_go_to_the_model_at_once(tokenizer):
    import public_tokenizers

    known = packing.WordIds(public_tokenizers.path(packing.TOKENIZER))
    known.tokenizer = Watched(known.tokenizer)
    words = ["plain", "Words,", "GR\u00dcSSE.", "gr\u00fc\u00dfe", "ni\u00f1os", "\u00e9t\u00e9!", "it's", "a1", "\u0142\u00f3d\u017a", "\u0435\u0449\u0451", "e\u0301t"]
    known.learn({w.encode() for w in words})
    assert set(known.tokenizer.seen) == {",", ".", "!", *words[6:]}
    assert all(np.frombuffer(known[w.encode()], "<u4").tolist() == tokenizer.encode(w, add_special_tokens=False).ids for w in words)


def test_words_that_keep_coming_are_not_forgotten(tokenizer):
    import public_tokenizers

    known = packing.WordIds(public_tokenizers.path(packing.TOKENIZER), 40)
    known.tokenizer = Watched(known.tokenizer)
    for k in range(30):
        known.learn({b"it's", *(b"x%d" % i for i in range(10 * k, 10 * k + 10))})
        assert len(known) + len(known.older) <= 40 + 2 * 11
        assert np.frombuffer(known[b"it's"], "<u4").tolist() == tokenizer.encode("it's", add_special_tokens=False).ids
    assert known.tokenizer.seen.count("it's") == 1 and len(known.tokenizer.seen) == 301


def test_pieces_over_a_whole_table(spark, sf, tokenizer):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = spark.createDataFrame([(900001, None, None, None, None), (900002, "", None, None, None), (900003, "word " * 9000, None, None, None)], DOCS)
    rows = {r["doc_id"]: r["text"] for r in docs.union(extra).collect()}
    got = packing.pack_documents(docs.union(extra)).toPandas()
    assert not got.duplicated(["doc_id", "piece"]).any()
    total = 0
    for doc, own in got.sort_values(["doc_id", "piece"]).groupby("doc_id"):
        ids = [*tokenizer.encode(rows[doc] or "", add_special_tokens=False).ids, 1]
        want = [(k, at, len(ids[at : at + 4096]), zlib.crc32(np.array(ids[at : at + 4096], "<u4").tobytes())) for k, at in enumerate(range(0, len(ids), 4096))]
        assert list(own[["piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == want
        total += len(ids)
    assert set(got["doc_id"]) == set(rows)
    for _, own in got.sort_values("offset").groupby("sequence_id"):
        assert own["offset"].tolist() == [0, *own["length"].cumsum()[:-1]] and own["length"].sum() <= 4096
    assert got["sequence_id"].nunique() <= 1.01 * -(-total // 4096) + 1
    assert packing.pack_documents(spark.createDataFrame([], DOCS)).isEmpty()


def test_rows_of_one_id_are_packed_apart(spark):
    got = packing.pack_documents(spark.createDataFrame([(1, "a b", "x", "y", 3), (1, "a b", "x", "y", 3), (None, "c", None, None, None)], DOCS)).collect()
    assert sorted(r["offset"] for r in got) == [0, 3, 6] and {r["sequence_id"] for r in got} == {0}


def test_packing_without_ids_is_the_same(spark):
    docs = documents(spark, ["Some words, here.", None, "x " * 9000, ""])
    both = [sorted(map(tuple, packing.pack_documents(docs, with_ids=k).drop("ids").collect())) for k in (True, False)]
    assert both[0] == both[1] and "ids" not in packing.pack_documents(docs, with_ids=False).columns
