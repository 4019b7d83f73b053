"""The divergence audit, the Merkle manifest and the passage classifier on odd tables, against plain versions, and on held-out rows."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from plain import DOCS, documents
from pyspark.sql import functions as F

from marginalia.llm import divergence as div
from marginalia.llm import merkle, passages
from marginalia.llm.tables import read

ODD = [
    (3, "b\nA b", "en", "x", 5), (1, "B c é", "en", "x", None), (1, "B c é", "en", "x", None), (None, "z", "en", "x", 1), (5, None, "en", None, None), (6, "", None, "", 0), (7, "ß ß", "de", "", 3),
    (8, "b " * 40, "en", "y", 80), (9, "B", "en", "yy", 1), (10, "same", "en", "x", 4), (12, "same", "en", "x", 4), (-4, "a\nb", "en", "x", 3),
]


def sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def plain_trees(rows):
    """(doc_id, leaf) -> (subroot, root, siblings, sides) by following the contract a node at a time."""

    def leaf(r):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], r[4], r[1])))

    def tree(nodes):
        """The root, and for each leaf the levels of (before, after)."""
        paths, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
        while len(level) > 1:
            for k, i in enumerate(at):
                run = level[i // 3 * 3 : i // 3 * 3 + 3]
                paths[k].append((run[: i % 3], run[i % 3 + 1 :]))
            level = [sha("".join(level[i : i + 3])) for i in range(0, len(level), 3)]
            at = [i // 3 for i in at]
        return level[0], paths

    groups = defaultdict(list)
    for r in rows:
        groups[r[3]].append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    inner = {}
    for s in order:
        own = sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        inner[s] = own, *tree([leaf(r) for r in own])
    root, tops = tree([inner[s][1] for s in order])
    out = []
    for s, top in zip(order, tops, strict=True):
        for r, path in zip(inner[s][0], inner[s][2], strict=True):
            acc = leaf((r[0], r[1].replace("\n", "") if r[1] is not None else None, *r[2:])) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 else leaf(r)
            for before, after in path + top:
                acc = sha("".join([*before, acc, *after]))
            out.append((r[0], leaf(r), inner[s][1], root, sha("".join(x for b, a in path + top for x in b + a)), acc, acc == root))
    return sorted(out, key=repr)


def audited(spark, docs):
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, merkle.leaf_digest(text=F.translate("text", "\n", "")))
    return sorted((tuple(r) for r in merkle.audit(docs, tampered).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr)


def test_manifest_of_odd_rows(spark):
    docs = spark.createDataFrame(ODD, DOCS).withColumns({"tree": F.lit("?"), "digest": F.lit("?"), "run": F.lit(1), "height": F.lit(2)})
    assert audited(spark, docs) == plain_trees(ODD)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 27, 28])
def test_manifest_of_any_size(spark, n):
    rows = [(i, f"t{i}\n", "en", "s", i) for i in range(n)]
    assert audited(spark, spark.createDataFrame(rows, DOCS)) == plain_trees(rows)


def test_manifest_of_many_sources_and_a_long_text(spark):
    rows = [(i, "é\n" * (200_000 if i == 3 else i % 4), "en", f"s{i % 11}" if i % 3 else "s0", i) for i in range(150)]
    assert audited(spark, spark.createDataFrame(rows, DOCS)) == plain_trees(rows)


def test_manifest_of_nothing(spark):
    assert merkle.audit(spark.createDataFrame([], DOCS)).collect() == []


def plain_divergence(rows, min_docs, top):
    words = lambda t: ["".join(w) for w in _runs(t or "")]
    n, df, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source, _ in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        n[lang, source].update(words(text))
        df[lang].update(set(words(text)))
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for t, k in df[lang].items() if k >= min_docs)

        def p(counts, kept=kept):
            size = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 5) // (size + 5 * len(kept)) for t in kept}

        q = p(sum((n[lang, s] for s in sources), Counter()))
        for s in sources:
            mine = p(n[lang, s])
            pairs = [(o, sum(abs(mine[t] - theirs[t]) for t in kept)) for o in sources - {s} for theirs in [p(n[lang, o])]]
            terms = [(t, mine[t] - q[t]) for t in kept if n[lang, s][t] and mine[t] > q[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                out += [(lang, s, part, item, v, k + 1) for k, (item, v) in enumerate(sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most])]
    return sorted(out)


def _runs(text):
    run = []
    for c in text:
        if ord(c) > 0x7F or c.isascii() and c.isalpha():
            run.append(c.lower() if c.isascii() else c)
        elif run:
            yield run
            run = []
    if run:
        yield run


def test_divergence_of_odd_rows(spark):
    docs = spark.createDataFrame(ODD, DOCS).withColumns({"term": F.lit("?"), "n": F.lit(1), "salt": F.lit(2), "v": F.lit(0)})
    for least, top in ((1, 50), (2, 2), (99, 50)):
        assert sorted(tuple(r) for r in div.divergence(docs, least, top).collect()) == plain_divergence(ODD, least, top)


def test_divergence_of_many_terms(spark, monkeypatch):
    rows = [(i, " ".join(f"{'abcdefghij'[i % 10]}{'klmnop'[(i * k) % 6]}x, Äß" for k in range(1 + i % 7)), ["en", "de"][i % 5 == 0], "hot" if i % 3 else f"s{i % 9}", 0) for i in range(300)]
    monkeypatch.setattr(div, "HELD", 3)
    monkeypatch.setattr(div, "CHUNK", 5)
    assert sorted(tuple(r) for r in div.divergence(spark.createDataFrame(rows, DOCS), 5, 3).collect()) == plain_divergence(rows, 5, 3)


def test_divergence_of_nothing_and_of_great_counts(spark):
    assert div.divergence(spark.createDataFrame([], DOCS)).collect() == []
    got = spark.range(1).select(div._p(F.lit(4 * 10**15), F.lit(9 * 10**15), F.lit(10**6)).alias("p")).first()["p"]
    assert got == 1 + 10**9 * (4 * 10**15 + 5) // (9 * 10**15 + 5 * 10**6)


def auc(scores, labels):
    order = np.argsort(scores)
    rank = np.empty(len(order))
    rank[order] = np.arange(1, len(order) + 1)
    good = labels == 1
    return (rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())


def test_passages_tell_held_out_documents_apart(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = read(spark, sf, "documents"), read(spark, sf, "labels")
    found = passages.scores(docs, passages.fit(docs, labels))
    assert found.count() == docs.count()
    rows = found.join(labels, "doc_id").where("held_out").select("doc_id", "score", "predicted", "quality").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in rows)
    right = np.mean([r["predicted"] == r["quality"] for r in rows])
    assert right >= 0.97
    assert auc(np.array([r["score"] for r in rows]), np.array([r["quality"] for r in rows])) >= 0.98


def test_passage_model_ignores_held_out_labels_and_all_but_the_text(spark):
    docs = spark.createDataFrame([(i, ("GO!! " if i % 2 else "calm words here. ") * 30, "en", "s", 1) for i in range(60)], DOCS)
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(60)], "doc_id long, quality int")
    lies = labels.withColumn("quality", F.when(passages.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    other = docs.withColumns({"lang": F.lit("?"), "source": F.lit("?"), "quality": F.lit(0), "score": F.lit(9), "label": F.lit(3)})
    one = sorted(map(tuple, passages.scores(docs, passages.fit(docs, labels)).collect()))
    assert one == sorted(map(tuple, passages.scores(other, passages.fit(other, lies)).collect()))
    assert all(predicted == 1 - i % 2 for i, _, _, predicted in one)


def test_passage_scores_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (None, "x", "en", "s", 1), (3, "a b " * 60, "en", "s", 1), (3, "a b " * 60, "en", "s", 1), (4, " \n ", "en", "s", 3), (5, "GO!! " * 99, "en", "s", 1), (7, "ü" * 700_000, "en", "s", 1)], DOCS)
    labels = spark.createDataFrame([(3, 1), (5, 0), (3, 1), (None, 1), (4, None), (8, 1)], "doc_id long, quality int")
    model = passages.fit(docs, labels)
    got = passages.scores(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (1, 2, 4)}) == 1
    assert len({r["score"] for r in got if r["doc_id"] == 3}) == 1
    none = labels.where("false")
    assert {r["score"] for r in passages.scores(docs, passages.fit(docs, none)).collect()} == {0.5}
    assert {r["score"] for r in passages.scores(docs, passages.fit(docs, labels.where("quality = 1"))).collect()} == {1.0}
    assert passages.scores(docs.where("false"), model).collect() == []


def test_passages_of_blocks_are_those_of_one_sweep(monkeypatch):
    texts = ["one two three. " * 400, "SHOUT!! " * 300 + "calm " * 200, "", "x" * 5000]
    rng = np.random.default_rng(1)
    w = passages.learn([rng.normal(size=(3, passages.FEATURES)).astype(np.float32) for _ in range(20)], np.arange(20) % 2, 0.5)
    together = w.scores(texts)
    for text, score in zip(texts, together, strict=True):
        x, of = passages.encode(list(passages.blocks(text)))
        h, e = w.passages(x)
        a = np.exp(e - e.max())
        z = (a / a.sum()) @ h
        assert score == pytest.approx(1 / (1 + np.exp(-(z @ w.weights["c"] + w.weights["b"][0]))))


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(3)
    bags = [rng.normal(size=(n, passages.FEATURES)) for n in (1, 4, 3)]
    y, weight = np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 0.5])
    w = {k: v.astype(np.float64) for k, v in passages.learn([b.astype(np.float32) for b in bags], y, 0.5).weights.items()}

    def loss():
        total = 0
        for b, t, g in zip(bags, y, weight, strict=True):
            h, e = passages.Model(0.5, w).passages(b)
            a = np.exp(e - e.max())
            p = 1 / (1 + np.exp(-((a / a.sum()) @ h @ w["c"] + w["b"][0])))
            total -= g * (t * np.log(p) + (1 - t) * np.log(1 - p)) / len(bags)
        return total

    grad = passages._gradients(w, bags, y, weight)
    for k, g in grad.items():
        at = tuple(rng.integers(0, s) for s in w[k].shape)
        held = w[k][at]
        w[k][at] = held + 1e-5
        up = loss()
        w[k][at] = held - 1e-5
        down = loss()
        w[k][at] = held
        assert g[at] == pytest.approx((up - down) / 2e-5, rel=1e-3, abs=1e-7)
