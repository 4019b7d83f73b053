"""Best-fit packing of token pieces into fixed-length sequences, after Martello-Toth dominance reduction.

What decides a packing is only how many pieces there are of each length, at most ``capacity`` numbers. The plan is made
from that histogram: first the reduction fixes bins that some optimal packing has, then best-fit decreasing places the
rest, a whole class of equally filled bins at a time. The plan is a list of segments ("the pieces number a to b of length L
go to the bins from c on, k in each, from offset d on"), whose number depends on ``capacity`` and not on the table, so it
can be broadcast. Each piece finds its place from its rank among the pieces of its length; ranks are counted in
hashed shards, so a frequent length is spread too.

Null text counts as empty; an empty text is its end token alone. Repeated rows are packed as rows of their own.
An empty table gives an empty result. The ids travel with their places, so the sequences can be read off the result.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.tables import BATCH_BYTES, take_columns, tidy, utf8, written

CAPACITY, END_ID = 4096, 1
TOKENIZER = "word_bpe_49k.json"
#: Words whose ids a task remembers, about: when half as many have come, those not met since the half before are forgotten.
CACHE_WORDS = 200_000
#: Words that are encoded at a time: the tokenizer's own notes take about a kilobyte a word while it runs.
LEARN_WORDS = 5_000

#: ASCII marks; not the apostrophe, which can stand within a word.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
MARK_BYTES = MARKS.encode()

Segment = tuple[int, int, int, int, int, int]


def reduce_dominated(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Martello-Toth: take out of counts (length: pieces) the sets that dominate every alternative. Returns (lengths, how often)."""
    fixed: list[tuple[tuple[int, ...], int]] = []
    live = sorted(x for x, n in counts.items() if n > 0)

    def take(lengths: tuple[int, ...], times: int) -> None:
        fixed.append((lengths, times))
        for x in lengths:
            counts[x] -= times
            if not counts[x]:
                live.remove(x)

    changed = True
    while changed:
        changed = False
        for x in reversed(live.copy()):
            while counts[x] > 0:
                room, n = capacity - x, counts[x]
                small: list[int] = []  # the three smallest others
                for y in live[:4]:
                    small += [y] * min(3, counts[y] - (y == x))
                small = small[:3]
                if not small or small[0] > room:
                    take((x,), n)
                elif room == x and n >= 2:
                    take((x, x), n // 2)
                elif room != x and counts.get(room, 0) > 0:
                    take((x, room), min(n, counts[room]))
                else:
                    best = live[bisect_right(live, room) - 1]
                    if best == x and n < 2:
                        k = bisect_left(live, x)
                        best = live[k - 1]
                    two = best + 1 if len(small) < 2 or small[0] + small[1] > room else best_pair(live, counts, x, room) if sum(small) > room or len(small) < 3 else None
                    if two is None or (len(small) >= 2 and small[0] + small[1] <= room and best < two):
                        break
                    take((x, best), n // 2 if best == x else min(n, counts[best]))
                changed = True
    return fixed


def best_pair(live: list[int], counts: dict[int, int], x: int, room: int) -> int:
    """The largest sum within room of two pieces besides one of length x; 0 if there is none."""
    best, a, b = 0, 0, len(live) - 1
    have = lambda y: counts[y] - (y == x)
    while a <= b:
        if not have(live[a]):
            a += 1
        elif not have(live[b]) or live[a] + live[b] > room:
            b -= 1
        else:
            if a < b or have(live[a]) > 1:
                best = max(best, live[a] + live[b])
            a += 1
    return best


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Segment]:
    """Segments (length, first rank, end rank, first bin, pieces in each bin, offset of the first).

    Best fit can do worse on fewer pieces, so the instance is packed without the reduction too, and fewer bins win.
    """
    if any(x < 1 or x > capacity for x, n in histogram.items() if n > 0):
        raise ValueError("a piece is longer than a sequence, or empty")
    return min((_planned(histogram, capacity, reduce) for reduce in (True, False)), key=lambda x: x[0])[1]


def _planned(histogram: dict[int, int], capacity: int, reduce: bool) -> tuple[int, list[Segment]]:
    counts = {x: n for x, n in histogram.items() if n > 0}
    rank = dict.fromkeys(counts, 0)
    segments: list[Segment] = []
    bins = 0

    def place(length: int, pieces: int, first_bin: int, each: int, offset: int) -> None:
        segments.append((length, rank[length], rank[length] + pieces, first_bin, each, offset))
        rank[length] += pieces

    for lengths, times in reduce_dominated(counts, capacity) if reduce else ():
        offset = 0
        if len(lengths) == 2 and lengths[0] == lengths[1]:
            place(lengths[0], 2 * times, bins, 2, 0)
        else:
            for x in lengths:
                place(x, times, bins, 1, offset)
                offset += x
        bins += times

    rooms: list[int] = []  # the sizes of room that open bins have, in order
    open_bins: dict[int, list[tuple[int, int]]] = {}

    def leave(room: int, first: int, n: int) -> None:
        if n and room:
            if room not in open_bins:
                insort(rooms, room)
            open_bins.setdefault(room, []).append((first, n))

    for length in sorted((x for x, n in counts.items() if n), reverse=True):
        left = counts[length]
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                room, first, n = capacity, bins, -(-left // (capacity // length))
                bins += n
            else:
                room = rooms[at]
                first, n = open_bins[room].pop()
                if not open_bins[room]:
                    del open_bins[room], rooms[at]
            each = room // length
            full = min(n, left // each)
            if full:
                place(length, full * each, first, each, capacity - room)
                leave(room - each * length, first, full)
                left -= full * each
                first, n = first + full, n - full
            if n and 0 < left < each:
                place(length, left, first, left, capacity - room)
                leave(room - left * length, first, 1)
                left, first, n = 0, first + 1, n - 1
            leave(room, first, n)
    return bins, segments


def plain_end(c: str) -> bool:
    """Whether c surely is a letter or digit to the tokenizer, whose normaliser leaves it one: not so for a dotted capital I, which gains a mark."""
    return ("0" <= c <= "9" or c.isalpha()) and (c < "\u0250" or "\u0410" <= c <= "\u044f") and len(c.lower()) == 1


class WordIds(dict):
    """Word: the bytes of its ids. White space ends every token of this vocabulary, so a text's ids are its words' ids.

    The vocabulary has small letters only, and marks after a letter or digit are tokens of their own: a word is first looked
    for in small letters and without its last marks. A word of plain letters is what the normaliser and the pre-tokenizer would
    hand on as it is, so it goes to the tokenizer's model at once; what else is left is encoded a batch of texts at a time.
    """

    def __init__(self, path: str, most: int = CACHE_WORDS) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.older: dict[bytes, bytes] = {}
        self.tokens = self.tokenizer.model.tokenize
        self.token_bytes = [x.tobytes() for x in np.arange(max(self.tokenizer.get_vocab().values()) + 1, dtype="<u4")]
        small = [c for c in map(chr, range(0x80, 0x100)) if c.isalpha() and c == c.lower()]
        self.letters = {ord(c): self.tokenizer.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in small}  # as the model has them

    def plain(self, word: bytes) -> str | None:
        """The model's form of a word of small Latin-1 letters alone, else None. Their normal form is their own, and the pre-tokenizer doesn't cut them."""
        if word.isalpha():  # ASCII alone
            return word.decode() if word.islower() else None
        if max(word) > 0xC3:  # the first byte of a letter beyond Latin-1
            return None
        text = word.decode()
        return text.translate(self.letters) if text.isalpha() and text == text.lower() else None

    @staticmethod
    def shorter(word: bytes) -> tuple[bytes, bytes]:
        """A simpler word and marks whose ids together are the word's; (word, b"") if there is none."""
        letters = word.rstrip(MARK_BYTES)
        if letters.isalpha() and len(word) - len(letters) < 2:  # ASCII, as most words are
            return letters.lower(), word[len(letters) :]
        text = word.decode()
        if "<|" in text or "|>" in text:
            return word, b""
        if not text.islower() and max(text) < "\u0100":
            text = text.lower()
        if text[-1] in MARKS and (bare := text.rstrip(MARKS)) and plain_end(bare[-1]):
            return bare.encode(), text[len(bare) :].encode()
        return text.encode(), b""

    def simple(self, word: bytes) -> bytes | None:
        """The ids of a word that is remembered or plain, else None."""
        ids = self.get(word)
        if ids is None:
            ids = self.older.get(word)
            if ids is None:
                letters = self.plain(word)
                if letters is None:
                    return None
                ids = b"".join([self.token_bytes[t.id] for t in self.tokens(letters)])
            self[word] = ids
        return ids

    def learn(self, words: set[bytes]) -> None:
        if 2 * len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        older, later = self.older, {}
        for w in words:
            if w in self:
                continue
            if w in older:
                self[w] = older[w]
                continue
            base, mark = self.shorter(w)
            ids, end = self.simple(base), self.simple(mark) if mark else b""
            if ids is None or end is None:
                later[w] = base, mark
            elif base != w:
                self[w] = ids + end
        bases = list({x for both in later.values() for x in both if x and x not in self})
        for k in range(0, len(bases), LEARN_WORDS):
            part = bases[k : k + LEARN_WORDS]
            texts = [w.decode() for w in part]
            got = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
            first = np.fromiter((x for x, _ in got.offsets), np.int64, len(got.ids))
            starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
            ids, ends = np.array(got.ids, "<u4"), np.searchsorted(first, starts)
            whole, at = ids.tobytes(), (4 * ends).tolist()
            self.update(zip(part, (whole[x:y] for x, y in zip(at, at[1:], strict=False)), strict=True))
        for w, (base, mark) in later.items():
            self[w] = self[base] + (self[mark] if mark else b"")

    def __missing__(self, word: bytes) -> bytes:
        ids = self[word] = np.array(self.tokenizer.encode(word.decode(), add_special_tokens=False).ids, "<u4").tobytes()
        return ids


def pieces(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False, cache_words: int = CACHE_WORDS) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32[, ids]): the token ids of each text and an end token, cut only where longer than capacity."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        known = WordIds(tokenizer_path or public_tokenizers.path(TOKENIZER), cache_words)  # goes with the task
        end = np.array([END_ID], "<u4").tobytes()
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
        names = [c.split()[0] for c in schema.split(", ")]

        def table(out: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=False)], names=names)

        for batch in batches:
            out: list[tuple] = []
            held = 0
            words = [utf8(t).split() for t in batch.column(1).to_pylist()]
            known.learn(set().union(*words))
            for doc, own in zip(batch.column(0).to_pylist(), words, strict=True):
                ids = b"".join(map(known.__getitem__, own)) + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    out.append((doc, k, k * capacity, len(part) // 4, zlib.crc32(part), *([np.frombuffer(part, "<i4")] if with_ids else ())))
                    held += len(part)
                if with_ids and held >= BATCH_BYTES:
                    yield table(out)
                    out, held = [], 0
            yield table(out)

    return take_columns(docs, "doc_id", "text").mapInArrow(tidy(cut), schema)


def pack(parts: DataFrame, capacity: int = CAPACITY, shard_rows: int = 20_000) -> DataFrame:
    """Adds sequence_id and offset to rows with doc_id, piece and length. parts is read several times: hand in a written table.

    A shard holds about shard_rows pieces and is one task's sort; a length of a third of all pieces is spread over all shards.
    """
    spark = parts.sparkSession
    histogram = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # capacity rows at most
    total = sum(histogram.values())
    places = spark.createDataFrame(plan(histogram, capacity), "_length long, _first long, _end long, _bin long, _each long, _offset long")
    shards = max(1, -(-total // shard_rows))
    rows = parts.withColumn("_shard", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)))
    sums = Window.partitionBy("length").orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy("length", "_shard").agg(F.count(F.lit(1)).alias("_n")).select("length", "_shard", F.coalesce(F.sum("_n").over(sums), F.lit(0)).alias("_before"))
    rows = rows.withColumn("_own", F.row_number().over(Window.partitionBy("length", "_shard").orderBy("doc_id", "piece")) - 1)
    rows = rows.join(before, ["length", "_shard"]).withColumn("_rank", F.col("_before") + F.col("_own"))
    # The plan's rows depend on capacity alone, some thousands, whatever the table holds.
    found = rows.join(F.broadcast(places), (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_end")))
    at = F.col("_rank") - F.col("_first")
    found = found.withColumns({"sequence_id": F.col("_bin") + F.floor(at / F.col("_each")), "offset": F.col("_offset") + at % F.col("_each") * F.col("_length")})
    return found.select(*parts.columns, "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, cache_words: int = CACHE_WORDS, with_ids: bool = True) -> DataFrame:
    """The pieces with their ids, sequence_id and offset: a sequence is the ids of its pieces in order of offset. with_ids: else only their digests are kept.

    cache_words: what a worker remembers, some 200 bytes each; it trades memory for time and changes no result.
    """
    return pack(written(pieces(docs, tokenizer_path, capacity, with_ids=with_ids, cache_words=cache_words), "pieces"), capacity)
