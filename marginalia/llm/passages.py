"""Quality classifier by multiple-instance learning: a document is a bag of passages, and gated attention says how much each counts.

A passage is ``PASSAGE_WORDS`` words; a text is cut at white space into blocks of at most ``BLOCK`` bytes first, so that a text of any length is
read whole in bounded memory. A passage's features are shares of kinds of bytes, figures of its words (length, capitals, repeats, marks) and hashed
pairs of bytes. With passage features x: h = tanh(x W), attention e = w . (tanh(h V) * sigmoid(h U)), a document's z is the mean of its h weighted by
softmax(e), and its score sigmoid(c . z + b). Only documents have labels; which passages matter is learned from them.

``fit`` takes at most ``FIT_DOCS`` labelled documents of each label, those of smallest hash of doc_id, and at most ``FIT_PASSAGES`` evenly spaced passages
of each; these bounds are parameters and the only place where less than everything is read. Repeated labels of a doc_id count as their mean,
of rows with one doc_id the smallest text is learned from. Where there are not texts of both labels to learn from, the score is that of the more frequent label everywhere; without any label it is 0.5.

``scores`` is one pass without a shuffle over whole texts: null and empty texts are one passage without words. A null doc_id stays null, repeated rows
are scored alike, an empty table gives no rows. The score sees nothing but the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.tables import take_columns, tidy, utf8

PASSAGE_WORDS, BLOCK = 48, 1 << 18
FIT_DOCS, FIT_PASSAGES = 1500, 32
HIDDEN, GATE, ROUNDS, BAGS, STEP, DECAY = 24, 12, 30, 64, 0.01, 1e-3
#: Bytes that are told apart; any other one is of the last kind.
KINDS = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", bytes(range(128, 256)), b".", b",;:", b"!?", b"'\"()[]{}", b"|", b"#*$%&<>", b"-_/\\@+=~^`", b"\n"]
PAIRS, WORD_FIGURES = 48, 8
FEATURES = len(KINDS) + 1 + WORD_FIGURES + PAIRS
_KIND = np.full(256, len(KINDS), np.int64)
for _i, _members in enumerate(KINDS):
    _KIND[list(_members)] = _i
_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\r\x0b\x0c")] = True
_LOW = np.arange(256, dtype=np.int64)
_LOW[65:91] += 32
_POWERS = np.cumprod(np.full(256, 0x100000001B3, np.uint64), dtype=np.uint64)


def blocks(text: str | None) -> Iterator[bytes]:
    """A text's bytes in blocks, cut at white space where there is some."""
    data = utf8(text)
    at = 0
    while len(data) - at > BLOCK:
        end = max(data.rfind(c, at + 1, at + BLOCK) for c in (b" ", b"\n"))
        end = end if end > 0 else at + BLOCK
        yield data[at:end]
        at = end
    yield data[at:]


def encode(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of the passages of some blocks, and which block each is of. A block without words has one passage of zeros."""
    raw = np.frombuffer(b" ".join(parts) + b" ", np.uint8)
    ends = np.cumsum([len(p) + 1 for p in parts])
    space = _SPACE[raw]
    first = ~space & np.concatenate([[True], space[:-1]])
    starts = np.flatnonzero(first)
    n_words = np.diff(np.searchsorted(starts, np.concatenate([[0], ends])))
    n_passages = np.maximum(1, -(-n_words // PASSAGE_WORDS))
    base = np.concatenate([[0], np.cumsum(n_passages)])
    block_of = np.repeat(np.arange(len(parts)), n_passages)
    total = int(base[-1])
    x = np.zeros((total, FEATURES), np.float32)
    if not len(starts):
        return x, block_of
    word_block = np.repeat(np.arange(len(parts)), n_words)
    within = np.arange(len(starts)) - np.repeat(np.cumsum(n_words) - n_words, n_words)
    passage = base[word_block] + within // PASSAGE_WORDS
    word_of = np.cumsum(first) - 1
    word_of[word_of < 0] = 0
    there = passage[word_of]  # white space goes with the word before it
    kinds = np.bincount(there * (len(KINDS) + 1) + _KIND[raw], minlength=total * (len(KINDS) + 1)).reshape(total, -1).astype(np.float32)
    kinds[:, -1] -= np.bincount(there[space & (raw != 10)], minlength=total)  # plain white space is no kind
    low = _LOW[raw]
    inner = ~space[:-1] & ~space[1:]
    pair = (low[:-1] * 31 + low[1:] * 7 + low[:-1] * low[1:]) % PAIRS
    pairs = np.bincount(there[:-1][inner] * PAIRS + pair[inner], minlength=total * PAIRS).reshape(total, PAIRS).astype(np.float32)

    ink = np.flatnonzero(~space)
    length = np.bincount(word_of[ink], minlength=len(starts))
    place = np.minimum(ink - starts[word_of[ink]], 255)
    spread = np.zeros(len(raw), np.uint64)
    spread[ink] = (low[ink] + 1).astype(np.uint64) * _POWERS[place]
    key = np.add.reduceat(spread, starts)  # a hash of each word
    kind_in = lambda k: np.bincount(word_of[ink[_KIND[raw[ink]] == k]], minlength=len(starts))
    lower, upper = kind_in(0) + kind_in(3), kind_in(1)
    last = raw[starts + length - 1]
    order = np.lexsort((key, passage))
    new = np.ones(len(order), bool)
    new[1:] = (key[order][1:] != key[order][:-1]) | (passage[order][1:] != passage[order][:-1])
    again = np.zeros(len(starts), bool)
    again[1:] = (key[1:] == key[:-1]) & (passage[1:] == passage[:-1])
    count = np.bincount(passage, minlength=total).astype(np.float32)
    per = lambda weights: np.bincount(passage, weights, minlength=total).astype(np.float32)
    figures = [
        count / PASSAGE_WORDS, per(np.minimum(length, 40)) / 8, per(length > 20), per((upper > 1) & (lower == 0)), per(lower + upper == 0),
        per(new[np.argsort(order, kind="stable")]), per(again), per((_KIND[last] >= 6) & (_KIND[last] < len(KINDS) - 1)),
    ]
    some = np.maximum(count, 1)
    at = len(KINDS) + 1
    x[:, :at] = np.sqrt(kinds / np.maximum(kinds.sum(1, keepdims=True), 1))
    x[:, at] = figures[0]
    x[:, at + 1 : at + WORD_FIGURES] = np.stack(figures[1:], 1) / some[:, None]
    x[:, at + WORD_FIGURES :] = np.sqrt(pairs / np.maximum(pairs.sum(1, keepdims=True), 1))
    return x, block_of


@dataclass(frozen=True)
class Model:
    """Weights of the classifier; without any it gives ``share`` everywhere."""

    share: float
    weights: dict[str, np.ndarray] | None = None

    def passages(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = self.weights
        h = np.tanh(((x - w["mean"]) / w["spread"]) @ w["W"] + w["k"])
        return h, (np.tanh(h @ w["V"]) / (1 + np.exp(-(h @ w["U"])))) @ w["w"]

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Scores of whole texts: blocks are encoded some at a time, and each text keeps the greatest attention so far and sums beneath it."""
        n = len(texts)
        if self.weights is None:
            return np.full(n, self.share)
        top, mass, mean = np.full(n, -1e30), np.zeros(n), np.zeros((n, HIDDEN))
        held: list[bytes] = []
        whose: list[int] = []
        size = 0

        def take() -> None:
            x, of = encode(held)
            h, e = self.passages(x)
            doc = np.array(whose)[of]
            greatest = top.copy()
            np.maximum.at(greatest, doc, e)
            fade = np.exp(top - greatest)
            a = np.exp(e - greatest[doc])
            mass[:] = mass * fade + np.bincount(doc, a, n)
            mean[:] = mean * fade[:, None]
            np.add.at(mean, doc, a[:, None] * h)
            top[:] = greatest

        for i, text in enumerate(texts):
            for part in blocks(text):
                held.append(part), whose.append(i)
                size += len(part)
                if size >= BLOCK:
                    take()
                    held, whose, size = [], [], 0
        if held:
            take()
        return 1 / (1 + np.exp(-((mean / mass[:, None]) @ self.weights["c"] + self.weights["b"][0])))


def learn(bags: list[np.ndarray], labels: np.ndarray, share: float, seed: int = 7) -> Model:
    """Fits the weights on bags of passage features, by Adam; documents weigh so that labels have the share they have among all that are labelled."""
    rng = np.random.default_rng(seed)
    every = np.concatenate(bags)
    w = {"mean": every.mean(0), "spread": every.std(0) + 1e-3}
    init = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)
    w |= {"W": init(FEATURES, HIDDEN), "k": np.zeros(HIDDEN, np.float32), "V": init(HIDDEN, GATE), "U": init(HIDDEN, GATE), "w": init(GATE), "c": init(HIDDEN), "b": np.zeros(1, np.float32)}
    learned = ["W", "k", "V", "U", "w", "c", "b"]
    own = labels.mean()
    weight = np.where(labels == 1, share / own, (1 - share) / (1 - own))
    m1, m2 = ({k: np.zeros_like(w[k]) for k in learned} for _ in range(2))
    t = 0
    for _ in range(ROUNDS):
        for some in np.array_split(rng.permutation(len(bags)), max(1, len(bags) // BAGS)):
            t += 1
            grad = _gradients(w, [bags[i] for i in some], labels[some], weight[some])
            for k in learned:
                g = grad[k] + DECAY * w[k]
                m1[k] = 0.9 * m1[k] + 0.1 * g
                m2[k] = 0.999 * m2[k] + 0.001 * g * g
                w[k] = w[k] - STEP * (m1[k] / (1 - 0.9**t)) / (np.sqrt(m2[k] / (1 - 0.999**t)) + 1e-8)
    return Model(share, w)


def _gradients(w: dict, bags: list[np.ndarray], y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean weighted cross-entropy of some bags."""
    n = np.array([len(b) for b in bags])
    start = np.cumsum(n) - n
    bag = np.repeat(np.arange(len(bags)), n)
    x = (np.concatenate(bags) - w["mean"]) / w["spread"]
    h = np.tanh(x @ w["W"] + w["k"])
    t, s = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
    e = (t * s) @ w["w"]
    a = np.exp(e - np.maximum.reduceat(e, start)[bag])
    a /= np.add.reduceat(a, start)[bag]
    z = np.add.reduceat(a[:, None] * h, start)
    p = 1 / (1 + np.exp(-(z @ w["c"] + w["b"][0])))
    d = (p - y) * weight / len(bags)  # by the score before the sigmoid
    dz = d[:, None] * w["c"]
    da = (h * dz[bag]).sum(1)
    de = a * (da - np.add.reduceat(a * da, start)[bag])
    dts = de[:, None] * w["w"]
    dt, ds = dts * s * (1 - t * t), dts * t * s * (1 - s)
    dh = a[:, None] * dz[bag] + dt @ w["V"].T + ds @ w["U"].T
    du = dh * (1 - h * h)
    return {"W": x.T @ du, "k": du.sum(0), "V": h.T @ dt, "U": h.T @ ds, "w": (t * s).T @ de, "c": z.T @ d, "b": np.array([d.sum()])}


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learned from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS, fit_passages: int = FIT_PASSAGES) -> Model:
    """The classifier, from documents that labels (doc_id, quality 0 or 1) hold and that aren't held out; see the module for its bounds."""
    own = take_columns(labels, "doc_id", "quality").where("doc_id is not null and quality in (0, 1)").where(~held_out(F.col("doc_id")))
    rated = own.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    counts = {r["label"]: r["n"] for r in rated.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return Model(0.5)
    share = counts.get(1, 0) / sum(counts.values())
    picked = [rated.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_docs) for k in (0, 1)]
    chosen = F.broadcast(picked[0].unionByName(picked[1]))  # 2 * fit_docs ids at most

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column(2).to_pylist():
                # Evenly spaced over all passages, and no more of them held than twice the number wanted.
                kept, every, at = [], 1, 0
                for part in blocks(text):
                    x = encode([part])[0]
                    kept += [(at + i, row) for i, row in enumerate(x) if (at + i) % every == 0]
                    at += len(x)
                    while len(kept) > 2 * fit_passages:
                        every *= 2
                        kept = [(i, row) for i, row in kept if i % every == 0]
                rows = np.stack([r for _, r in kept])
                rows = rows[np.unique(np.linspace(0, len(rows) - 1, min(len(rows), fit_passages)).astype(int))]
                found.append(rows.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], names=["doc_id", "label", "bag"])

    texts = take_columns(docs, "doc_id", "text").join(chosen, "doc_id").groupBy("doc_id", "label").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    rows = sorted(texts.select(F.col("doc_id").cast("long"), "label", "text").mapInArrow(tidy(bags), "doc_id long, label int, bag binary").collect())
    if len({r["label"] for r in rows}) < 2:
        return Model(float(round(share)))
    return learn([np.frombuffer(r["bag"], np.float32).reshape(-1, FEATURES) for r in rows], np.array([r["label"] for r in rows], float), share)


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, held_out, score, predicted."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(model.scores(batch.column(2).to_pylist()), pa.float64())], names=["doc_id", "held_out", "score"])

    own = take_columns(docs, "doc_id", "text").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()
    return own.mapInArrow(tidy(score), f"doc_id {kind}, held_out boolean, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
