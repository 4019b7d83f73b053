import zlib
from pathlib import Path

import corpus_pipeline
import numpy as np
from plain import by_id, near_classes

from marginalia.llm import packing, quality
from marginalia.llm.mixing import mix
from marginalia.llm.tables import written


def test_stages_take_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "near-duplicates", "personal data", "source mix", "packing"]
    step = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = written(stage(spark, docs, sf), "stage")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        step[name] = (before, docs)
    before, after = step["quality rules"]
    assert {r["doc_id"]: r["text"] for r in after.collect()} == {r["doc_id"]: t for r in before.collect() for f, t in [quality.clean(r["text"])] if f[-1]}
    before, after = step["near-duplicates"]
    classes = near_classes({r["doc_id"]: r["text"] for r in before.collect()}, 5)
    assert set(by_id(after)) == {i for i, (_, c) in classes.items() if i == c}
    before, after = step["personal data"]
    assert set(by_id(before)) == set(by_id(after)) and any("[EMAIL]" in r["text"] for r in after.collect()) and not any("@" in r["text"] and ".example.com" in r["text"] for r in after.collect())
    before, after = step["source mix"]
    taken = {r["doc_id"]: r["taken"] for r in mix(before).collect() if r["taken"]}
    words = {}
    for r in after.collect():
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + len(r["text"].split())
    assert set(words) == set(taken)
    placed = corpus_pipeline.STAGES[-1][1](spark, docs, sf).toPandas()
    assert placed["length"].sum() == packing.pieces(docs).agg({"length": "sum"}).first()[0]
    for _, own in placed.sort_values("offset").groupby("sequence_id"):
        assert own["offset"].tolist() == [0, *own["length"].cumsum()[:-1]] and own["length"].sum() <= 4096


def test_run_applies_them_all(spark, sf):
    assert set(corpus_pipeline.run(spark, sf).columns) >= {"doc_id", "piece", "sequence_id", "offset", "length"}


def test_the_last_stage_holds_the_sequences(spark, sf):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    rows = [(1, "Some words of a text, as they stand.", "en", "a", 36), (1, "words only", "en", "a", 10), (2, "x " * 5000, "en", "b", 10000), (None, None, None, None, None)]
    mixed = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    placed = corpus_pipeline.packing(spark, mixed, sf).toPandas()
    sequences = [[int(i) for ids in own.sort_values("offset")["ids"] for i in ids] for _, own in placed.groupby("sequence_id")]
    assert sorted(map(len, sequences), reverse=True) == sorted(placed.groupby("sequence_id")["length"].sum(), reverse=True)
    runs = [[*tokenizer.encode(t or "", add_special_tokens=False).ids, packing.END_ID] for _, t, *_ in rows]
    want = sorted(r[k : k + packing.CAPACITY] for r in runs for k in range(0, len(r), packing.CAPACITY))
    assert sorted(list(map(int, x)) for x in placed["ids"]) == want
    for _, r in placed.iterrows():
        assert r["length"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
    assert sorted(i for s in sequences for i in s) == sorted(i for r in runs for i in r)


def test_sequences_of_the_run_are_the_mixed_texts(spark, sf, monkeypatch):
    texts = []

    def watched(df, name, **more):
        out = written(df, name, **more)
        if name == "source-mix":  # looked at now: the run deletes it
            texts.extend(packing.pieces(out, with_ids=True).select("ids").collect())
        return out

    monkeypatch.setattr(corpus_pipeline, "written", watched)
    placed = corpus_pipeline.run(spark, sf).select("doc_id", "piece", "start", "ids", "length", "sequence_id", "offset").toPandas()
    assert sorted(tuple(x) for x in placed["ids"]) == sorted(tuple(r["ids"]) for r in texts)
    for _, own in placed.sort_values("offset").groupby("sequence_id"):
        assert own["offset"].tolist() == [0, *own["ids"].map(len).cumsum()[:-1]]


def test_near_dedup_keeps_one_row_of_exact_copies(spark, sf):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a), (1, a), (2, b), (2, c), (None, b), (None, a + " more " + b), (None, a + " more " + b), (3, a), (None, None), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_dedup(spark, docs, sf)
    assert got.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=repr) == sorted([(1, a), (2, b), (2, c), (None, a + " more " + b), (None, None)], key=repr)


ODD = "doc_id long, text string, lang string, source string, n_chars long, _stays int, _apart string, _row string, _size long, `_mixrow` int, extra map<string, int>"


def odd_rows():
    prose = lambda k: " ".join(f"word{k}x{i}" for i in range(70)).capitalize() + "."
    rows = [(1, prose(1)), (1, prose(1)), (2, prose(1)), (3, prose(3)), (4, None), (None, prose(1)), (None, prose(6)), (None, prose(6)), (5, ""), (7, prose(7) + "\n" + "\n".join(prose(k) for k in range(100, 400)))]
    return [(i, t, "en", None if i == 3 else "s", None if t is None else len(t), k, "a", "r", k, k, {"k": k}) for k, (i, t) in enumerate(rows)]


def test_stages_on_odd_tables(spark, sf):
    """Clashing names, maps, nulls, repeats and a long text through every stage; then the same stages on no rows."""
    docs = spark.createDataFrame(odd_rows(), ODD)
    kept = corpus_pipeline.near_dedup(spark, docs, sf)
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"], (r["text"] or "")[:6]) for r in kept.collect()), key=repr) == sorted([(1, "Word1x"), (3, "Word3x"), (4, ""), (None, "Word6x"), (5, ""), (7, "Word7x")], key=repr)
    assert {r["extra"]["k"] == r["_stays"] for r in kept.collect()} == {True}
    mixed = corpus_pipeline.source_mix(spark, kept, sf)
    assert mixed.columns == docs.columns and {r["_row"] for r in mixed.collect()} == {"r"}
    for rows in (docs, docs.where("false")):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            rows = written(stage(spark, rows, sf), "stage")
            assert rows.columns == docs.columns
        placed = corpus_pipeline.packing(spark, rows, sf)
        assert placed.count() >= rows.count()


def test_a_run_leaves_its_result_alone(spark, sf):
    folder = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = set(folder.iterdir())
    rows = corpus_pipeline.run(spark, sf)
    left = sorted(p.name.rsplit("-", 1)[0] for p in set(folder.iterdir()) - before)
    assert left == ["packing"] and rows.count() > 0
