"""Benchmark decontamination with an FM-index for each training shard.

A shard is a run of documents of at most SHARD_BYTES of text inside one task. Its words become symbols of the benchmark's
vocabulary; words outside that vocabulary cannot lie in a phrase, so a run of them, like the border of a document, is one
separator. The shard's suffix array gives the Burrows-Wheeler transform, which a wavelet matrix ranks; every test phrase is
searched backwards through those ranks, its occurrences are located by walking to sampled suffix positions, and the word spans
found are merged. Nothing is hashed: words are compared as bytes, so the result is exact.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphmill.llm.rows import map_batches, parts_of, pick, positional, raw_of, settle

WINDOW = 10
SHARD_BYTES = 4 << 20
#: Text of the benchmark held at once; a larger one is searched in several passes.
BLOCK_BYTES = 8 << 20
SAMPLE = 8

#: A-Z to lower case; any byte that isn't in a word to a space. Bytes from 0x80 are parts of letters.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile(rb"[^ ]+")


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(FOLD).split()


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Order of all suffixes. Symbol 0 separates: each 0 differs from any other, and sorts by its place. Ends with a 0."""
    n = len(symbols)
    zeros = symbols == 0
    rank = symbols.astype(np.int64) + int(zeros.sum())
    rank[zeros] = np.arange(int(zeros.sum()))
    live = np.arange(n)
    key = rank.copy()
    order = np.argsort(key)
    sa = live[order]
    # ranks become the first row of the group of equal keys
    base = np.zeros(n, np.int64)
    step = 1
    slots = np.arange(n)
    while True:
        sorted_key = key[order]
        fresh = np.empty(len(order), bool)
        fresh[:1] = True
        np.not_equal(sorted_key[1:], sorted_key[:-1], out=fresh[1:])
        starts = np.nonzero(fresh)[0]
        sizes = np.diff(np.append(starts, len(order)))
        base = np.repeat(slots[starts], sizes)
        members = live[order]
        sa[slots] = members
        rank[members] = base
        open_ = np.repeat(sizes > 1, sizes)
        if not open_.any():
            return sa
        slots, live = slots[open_], members[open_]
        key = (rank[live] << 32) | rank[live + step]
        order = np.argsort(key)
        step *= 2


class WaveletMatrix:
    """Ranks of symbols in a sequence: a bit vector for each bit of a symbol, with counts at every 64th place."""

    def __init__(self, sequence: np.ndarray, sigma: int):
        self.depth = max(1, int(sigma - 1).bit_length())
        self.words, self.counts, self.zeros = [], [], []
        seq = sequence.astype(np.int32)
        for level in range(self.depth - 1, -1, -1):
            bit = (seq >> level & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            packed = np.pad(packed, (0, 16 - len(packed) % 8)).view("<u8")
            self.words.append(packed)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)[:-1]]))
            self.zeros.append(len(seq) - int(bit.sum()))
            seq = np.concatenate([seq[~bit], seq[bit]])
        self.first = self._down(np.arange(1 << self.depth), np.zeros(1 << self.depth, np.int64))

    def _ones(self, k: int, i: np.ndarray) -> np.ndarray:
        w = i >> 6
        return self.counts[k][w] + np.bitwise_count(self.words[k][w] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))

    def _down(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k in range(self.depth):
            ones = self._ones(k, i)
            i = np.where(symbol >> (self.depth - 1 - k) & 1, self.zeros[k] + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before place i."""
        return self._down(symbol, i) - self.first[symbol]

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at place i, and how often it occurs before."""
        symbol = np.zeros(len(i), np.int64)
        for k in range(self.depth):
            bit = (self.words[k][i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)
            ones = self._ones(k, i)
            symbol = symbol << 1 | bit.astype(np.int64)
            i = np.where(bit == 1, self.zeros[k] + ones, i - ones)
        return symbol, i - self.first[symbol]


class FMIndex:
    """Counts and locates sequences of nonzero symbols in a text of symbols whose zeros separate."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        symbols = np.append(symbols, 0).astype(np.int32)
        sa = suffix_array(symbols)
        before = symbols[sa - 1]
        before[sa == 0] = 0
        self.ranks = WaveletMatrix(before, sigma)
        self.below = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=sigma))])
        # a suffix after a separator is always sampled, so no walk crosses one
        kept = (sa % SAMPLE == 0) | (before == 0)
        self.kept = np.cumsum(kept, dtype=np.int64)
        self.marks, self.places, self.size = kept, sa[kept], len(sa)

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search of all rows of `phrases`: those that occur, and the rows of the suffix array [low, high) of each."""
        which = np.arange(len(phrases))
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.size, np.int64)
        for at in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[which, at]
            low, high = self.below[c] + self.ranks.rank(c, low), self.below[c] + self.ranks.rank(c, high)
            some = low < high
            which, low, high = which[some], low[some], high[some]
        return which, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in the text of rows of the suffix array."""
        out = np.zeros(len(rows), np.int64)
        todo, walked = np.arange(len(rows)), 0
        while len(todo):
            done = self.marks[rows]
            out[todo[done]] = self.places[self.kept[rows[done]] - 1] + walked
            todo, rows = todo[~done], rows[~done]
            if len(todo):
                c, before = self.ranks.access(rows)
                rows = self.below[c] + before
            walked += 1
        return out


class Phrases:
    """A block of test items as windows of symbols, grouped by length."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        self.names = sorted({name for name, _ in items})
        number = {name: k for k, name in enumerate(self.names)}
        words = [np.fromiter((self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(raw)), np.int32) for _, raw in items]
        widths = np.array([min(window, len(w)) for w in words], np.int64)
        self.groups: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # windows of one width, the items of all, where each window's begin and end
        for width in sorted({*widths.tolist()} - {0}):
            chosen = np.nonzero(widths == width)[0].tolist()
            parts = [np.lib.stride_tricks.sliding_window_view(words[k], width) for k in chosen]
            of = np.repeat([number[items[k][0]] for k in chosen], [len(x) for x in parts])
            phrases, which = np.unique(np.concatenate(parts), axis=0, return_inverse=True)
            pairs = np.unique(which.ravel().astype(np.int64) * len(self.names) + of)
            self.groups.append((phrases, (pairs % len(self.names)).astype(np.int32), np.searchsorted(pairs // len(self.names), np.arange(len(phrases) + 1))))

    def find(self, docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, list[tuple[int, list[str]]]]:
        """Hit word spans [start, end) counted over all documents' words, merged, and the items of each that has any."""
        sizes = np.fromiter(map(len, docs), np.int64, len(docs))
        firsts = np.concatenate([[0], np.cumsum(sizes)])
        get, total = self.vocabulary.get, int(firsts[-1])
        symbols = np.zeros(total + len(docs), np.int32)
        for k, words in enumerate(docs):
            at = int(firsts[k]) + k
            symbols[at : at + len(words)] = np.fromiter(map(get, words, repeat(0)), np.int32, len(words))
        owner = np.repeat(np.arange(len(docs)), sizes + 1)
        kept = np.nonzero((symbols != 0) | np.concatenate([[True], symbols[:-1] != 0]))[0] if len(symbols) else np.zeros(0, np.int64)
        if not len(kept) or not self.groups:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), []
        index = FMIndex(symbols[kept], len(self.vocabulary) + 1)
        starts, ends, pairs = [], [], set()
        for phrases, items, at_items in self.groups:
            which, low, high = index.search(phrases)
            if not len(which):
                continue
            counts = high - low
            rows = np.repeat(low, counts) + np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
            at = kept[index.locate(rows)]
            doc, of = owner[at], np.repeat(which, counts)
            starts.append(at - doc)
            ends.append(at - doc + phrases.shape[1])
            for d, p in {*zip(doc.tolist(), of.tolist(), strict=True)}:
                pairs.update((d, self.names[k]) for k in items[at_items[p] : at_items[p + 1]].tolist())
        if not starts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), []
        starts, ends = np.concatenate(starts), np.concatenate(ends)
        cover = np.zeros(total + 1, np.int64)
        np.add.at(cover, starts, 1)
        np.add.at(cover, ends, -1)
        hit = np.cumsum(cover[:-1]) > 0
        edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
        # a border between documents ends a span
        opens = np.union1d(np.nonzero(edge == 1)[0], b[hit[b] & (hit[b - 1])] if len(b := firsts[1:-1][(firsts[1:-1] > 0) & (firsts[1:-1] < total)]) else [])
        closes = np.union1d(np.nonzero(edge == -1)[0], b[hit[b] & hit[b - 1]] if len(b) else [])
        by: dict[int, list[str]] = {}
        for d, item in pairs:
            by.setdefault(d, []).append(item)
        return opens.astype(np.int64), closes.astype(np.int64), sorted(by.items())


def _blocks(benchmark: DataFrame, item_id: str, text: str, limit: int) -> Iterator[list[tuple[str, bytes]]]:
    block: list[tuple[str, bytes]] = []
    held = 0
    for row in pick(benchmark, item_id, text).where(F.col(text).isNotNull()).toLocalIterator():
        raw = row[1].encode()
        if block and held + len(raw) > limit:
            yield block
            block, held = [], 0
        block.append(("" if row[0] is None else str(row[0]), raw))
        held += len(raw)
    yield block


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents with n_words, hits (merged word spans, flat) and items (ids of the items with a window that occurs).

    Blocks of the benchmark are broadcast one after another; each is of block_bytes of text at most, or one item. Beyond the first
    block a pass reads the texts anew and keeps only (digest of the text, hits, items) of the distinct texts that are hit. Null
    texts have no words. The added columns go before those of the input, which are named _c0, _c1, ... here.
    """
    added = [T.StructField("n_words", T.LongType()), T.StructField("hits", T.ArrayType(T.LongType())), T.StructField("items", T.ArrayType(T.StringType()))]
    docs, (place,) = positional(docs, text)
    names = docs.columns
    at = names.index(place)
    digest = F.sha2(F.coalesce(F.col(place), F.lit("")), 256)
    first: DataFrame | None = None
    more: list[DataFrame] = []
    for block in _blocks(benchmark, item_id, item_text, block_bytes):
        held = docs.sparkSession.sparkContext.broadcast(Phrases(block, window))

        def found(b: pa.RecordBatch, column: int, held=held) -> list[pa.Array]:
            shard = [words_of(x) for x in raw_of(b.column(column))]
            firsts = np.concatenate([[0], np.cumsum([len(x) for x in shard])]).astype(np.int64)
            opens, closes, of = held.value.find(shard)
            hits: list[list[int]] = [[] for _ in shard]
            for s, e, d in zip(opens.tolist(), closes.tolist(), (np.searchsorted(firsts, opens, side="right") - 1).tolist(), strict=True):
                hits[d] += [s - int(firsts[d]), e - int(firsts[d])]
            items = dict(of)
            return [pa.array([len(x) for x in shard], pa.int64()), pa.array(hits, pa.list_(pa.int64())), pa.array([sorted(items.get(k, [])) for k in range(len(shard))], pa.list_(pa.string()))]

        if first is None:

            def whole(batches: Iterator[pa.RecordBatch], found=found) -> Iterator[pa.RecordBatch]:
                for b in parts_of(batches, at, SHARD_BYTES):
                    yield pa.RecordBatch.from_arrays([*found(b, at), *b.columns], names=[f.name for f in added] + names)

            first = map_batches(docs, whole, T.StructType([*added, *docs.schema.fields]))
        else:

            def hit(batches: Iterator[pa.RecordBatch], found=found) -> Iterator[pa.RecordBatch]:
                for b in parts_of(batches, 1, SHARD_BYTES):
                    new = found(b, 1)
                    some = np.nonzero(np.diff(new[1].offsets.to_numpy()))[0]
                    yield pa.RecordBatch.from_arrays([b.column(0).take(some), new[1].take(some), new[2].take(some)], names=["seal", "hits", "items"])

            more.append(settle(map_batches(docs.select(digest.alias("seal"), F.col(place)), hit, "seal string, hits array<bigint>, items array<string>").dropDuplicates(["seal"])))
    if not more:
        return first
    rest = more[0]
    for df in more[1:]:
        rest = rest.union(df)
    rest = rest.groupBy("seal").agg(F.flatten(F.collect_list("hits")).alias("_hits"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("_items"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = [(h or []) + (g or []) for h, g in zip(b.column(1).to_pylist(), b.column(b.num_columns - 2).to_pylist(), strict=True)]
            hits = [[x for pair in _merge([*zip(h[::2], h[1::2], strict=True)]) for x in pair] for h in both]
            items = [sorted({*(x or []), *(y or [])}) for x, y in zip(b.column(2).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(hits, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string())), *b.columns[3:-2]], names=[f.name for f in added] + names)

    return map_batches(first.join(rest, digest == F.col("seal"), "left").drop("seal"), merge, T.StructType([*added, *docs.schema.fields]))


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated), a row for each input row.

    Null, empty and wordless texts have no words and no hits; an empty benchmark hits nothing. An item of fewer words than a window
    is one window. Items of equal id count once; a null item_id is written as an empty text.
    """
    df = scan(pick(docs, doc_id, text), benchmark, text, item_id, item_text, window)
    n_hit = F.aggregate(F.transform("hits", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda a, x: a + x)
    return df.select(
        F.col("_c0").alias("doc_id"),
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def cut_words(raw: bytes, hits: list[int]) -> bytes:
    """The text without the hit words; what stands between the words of a span goes with them."""
    places = [m.span() for m in _WORD.finditer(raw.translate(FOLD))]
    out, at = [], 0
    for s, e in zip(hits[::2], hits[1::2], strict=True):
        out.append(raw[at : places[s][0]])
        at = places[e - 1][1]
    return b"".join([*out, raw[at:]])


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """The documents with every merged removal span cut from their text; rows without a hit are unchanged, nulls stay null."""
    df = scan(docs, benchmark, text, item_id, item_text, window)
    names = df.columns[3:]
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hits = b.column(1).to_pylist()
            columns = list(b.columns[3:])
            if any(hits):
                texts = columns[at].cast(pa.binary()).to_pylist()
                cut = [cut_words(t, h) if h else t for t, h in zip(texts, hits, strict=True)]
                columns[at] = pa.array(cut, pa.binary()).cast(columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return map_batches(df, run, T.StructType(df.schema.fields[3:])).toDF(*docs.columns)
