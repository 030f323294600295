"""Packing of tokenised documents into sequences by cutting-stock column generation.

A document's ids are cut into pieces of the full capacity and one remainder. The histogram of lengths, in units of UNIT tokens
rounded up, goes to the driver (capacity / UNIT numbers, whatever the corpus holds), where patterns are generated. Every
piece gets its rank among those of its size from per-task counts and their prefix sums, and the ranks are dealt to the patterns'
sequences by a broadcast table of as many rows as the patterns have entries.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import compress, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glyphmill.llm.cutting import solve
from glyphmill.llm.rows import buffers_of, map_batches, pick, settle, slices

CAPACITY = 4096
UNIT = 8
END_ID = 2
#: About so many bytes of words are remembered by a task, and so many go with each beside its characters.
REMEMBERED_BYTES, ENTRY_BYTES = 64 << 20, 220


@lru_cache(1)
def _whole(spec: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_str(spec)


@lru_cache(1)
def _by_word(spec: str):
    """The tokenizer that takes words as the whole one's byte-level step leaves them, and which ids end a word."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    plain = json.loads(spec) | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}
    ends = np.zeros(max(plain["model"]["vocab"].values()) + 1, bool)
    ends[[k for token, k in plain["model"]["vocab"].items() if token.endswith("</w>")]] = True
    return Tokenizer.from_str(json.dumps(plain)), ends


def _byte_characters() -> dict[int, str]:
    """The visible character that stands for each byte in byte-level vocabularies: itself where visible, else the next from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + k) for k, b in enumerate(others)}


_VISIBLE = _byte_characters()
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_PLAIN = re.compile("[!-\u012f\u0131-\u024f]+")

#: Texts' characters below this are sorted into kinds here; a chunk with another, or with U+0130, goes to the tokenizer whole.
_KNOWN = 0x250
_BLANK, _LETTER, _NUMBER, _OTHER, _ODD = range(5)
_WORDS_AT_ONCE = 2000


def _kinds() -> np.ndarray:
    """The kind of each character below _KNOWN, in the tokenizer's sense."""
    spaces, letters, numbers = (regex.compile(x) for x in (r"\s", r"\p{L}", r"\p{N}"))
    kind = [_BLANK if spaces.match(c) else _LETTER if letters.match(c) else _NUMBER if numbers.match(c) else _OTHER for c in map(chr, range(_KNOWN))]
    for odd in (*range(0x1C, 0x20), 0x130):
        kind[odd] = _ODD
    return np.array(kind, np.uint8)


_KIND = _kinds()
_BYTE_KIND = np.concatenate([_KIND[:128], np.full(128, _ODD, np.uint8)])


def word_starts(d: np.ndarray, marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of UTF-8 bytes, the last of them a blank: which of them open a word, and which are white space.

    Words are the tokenizer's: endings after an apostrophe, runs of letters, single numbers, runs of other characters. A chunk between
    white space that has a character of no known kind, or a byte of `marked`, is one word.
    """
    kind = _BYTE_KIND[d]
    first = np.nonzero((d >= 0xC2) & (d <= 0xC9))[0]
    if len(first):
        code = (d[first].astype(np.int64) & 0x1F) << 6 | (d[first + 1] & 0x3F)
        kind[first] = kind[first + 1] = np.where(code < _KNOWN, _KIND[np.minimum(code, _KNOWN - 1)], _ODD)
    kind[marked] = _ODD
    blank = kind == _BLANK
    prior = np.concatenate([[_BLANK], kind[:-1]]) if len(d) else kind
    opens = (kind != prior) | (kind == _NUMBER)
    opens[(d & 0xC0) == 0x80] = False
    opens &= ~blank
    quote = np.nonzero(opens & (d == 39))[0]
    if len(quote):
        one, two = (_LOWER[np.append(d, 0)[quote + k]] for k in (1, 2))
        pair = one.astype(np.int64) << 8 | two
        size = np.where(np.isin(one, list(b"stmd")), 2, np.where(np.isin(pair, [int.from_bytes(x) for x in (b"re", b"ve", b"ll")]), 3, 0))
        quote, size = quote[size > 0], size[size > 0]
        opens[quote + 1] = False
        after = quote + size
        opens[after] |= ~blank[after]
    odd = np.nonzero(kind == _ODD)[0]
    if len(odd):
        gaps = np.nonzero(blank)[0]
        k = np.searchsorted(gaps, odd)
        low, at = np.unique(np.where(k > 0, gaps[k - 1] + 1, 0), return_index=True)
        inside = np.zeros(len(d), np.int8)
        inside[low], inside[gaps[k[at]]] = 1, -1
        opens[np.cumsum(inside, dtype=np.int8) > 0] = False
        opens[low] = True
    return opens, blank


class Generations:
    """A cache of bytes in two generations: what recurs moves to the younger one, and when that is full the older one is forgotten."""

    def __init__(self, most: int):
        self.most = most // 2
        self.young, self.old, self.size = {}, {}, 0

    def look_up(self, keys: list[str], learn: Callable[[list[str]], list[bytes]]) -> dict[str, bytes]:
        """A table that has the keys, distinct ones; `learn` is asked for those not remembered."""
        if self.size > self.most:
            self.young, self.old, self.size = {}, self.young, 0
        young, old = self.young, self.old
        wanted = [k for k in keys if k not in young]
        again = {k: old[k] for k in wanted if k in old}
        new = [k for k in wanted if k not in again] if again else wanted
        young.update(again)
        young.update(zip(new, learn(new), strict=True))
        self.size += ENTRY_BYTES * len(wanted) + 3 * sum(map(len, wanted))
        return young


class WordTokenizer:
    """Ids of whole texts by way of their words, each of which is looked up or tokenised once.

    Right for word_bpe_49k, whose words never reach across white space and which drops it: a text's ids are then those of its words in
    a row. Ids are kept as little-endian unsigned 32-bit bytes.
    """

    def __init__(self, spec: str, remembered: int = REMEMBERED_BYTES):
        self.spec, (self.plain, self.ends) = spec, _by_word(spec)
        self.words = Generations(remembered)

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in _whole(self.spec).encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def _learn(self, new: list[str]) -> list[bytes]:
        """Words of known kinds go many at a time; their ids are cut apart where a word ends."""
        plain = [bool(_PLAIN.fullmatch(w)) and "<|" not in w for w in new]
        known, others = iter(self._in_lines([w.lower() for w in compress(new, plain)])), iter(self._encode([w for w, p in zip(new, plain, strict=True) if not p]))
        return [next(known if p else others) for p in plain]

    def _in_lines(self, new: list[str]) -> list[bytes]:
        visible = [w if w.isascii() and w.isprintable() else w.encode().decode("latin-1").translate(_VISIBLE) for w in new]
        lines = [" ".join(visible[at : at + _WORDS_AT_ONCE]) for at in range(0, len(new), _WORDS_AT_ONCE)]
        out: list[bytes] = []
        for k, got in enumerate(self.plain.encode_batch_fast(lines, add_special_tokens=False) if lines else []):
            ids = np.array(got.ids, "<u4")
            cuts = [0, *(4 * np.nonzero(self.ends[ids])[0] + 4).tolist()]
            part, raw = new[k * _WORDS_AT_ONCE : (k + 1) * _WORDS_AT_ONCE], ids.tobytes()
            out += [raw[a:b] for a, b in pairwise(cuts)] if len(cuts) == len(part) + 1 else self._encode(part)
        return out

    def encode(self, texts: pa.Array, end: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, each text's followed by `end`, and where each text's begin and end."""
        offsets, data = buffers_of(texts)
        data = np.insert(data[offsets[0] : offsets[-1]], offsets[1:] - offsets[0], 32)  # a blank after each text
        offsets = offsets - offsets[0] + np.arange(len(offsets))
        marked = np.nonzero((data[:-1] == 60) & (data[1:] == 124))[0]
        # words are the same in lower case, but for the marks of special tokens
        lower = _LOWER[data]
        if len(marked):
            of = np.unique(np.searchsorted(offsets, marked, side="right") - 1)
            for k in of.tolist():
                lower[offsets[k] : offsets[k + 1]] = data[offsets[k] : offsets[k + 1]]
        opens, blank = word_starts(lower, marked)
        kept = lower[~blank]
        starts = np.append(np.nonzero(opens[~blank])[0], len(kept)).astype(np.int64)
        coded = pa.LargeStringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts), pa.py_buffer(kept)).dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        got = self.words.look_up(distinct, self._learn)
        raw = [*map(got.__getitem__, distinct), end]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
        begins = np.cumsum(sizes) - sizes
        at = np.concatenate([[0], np.cumsum(opens, dtype=np.int64)])[offsets]
        which = np.insert(coded.indices.to_numpy().astype(np.int64), at[1:], len(distinct))
        n = sizes[which]
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = np.frombuffer(b"".join(raw), "<u4")[np.arange(ends[-1]) + np.repeat(begins[which] - ends[:-1], n)]
        return ids, ends[at + np.arange(len(at))]


def _forget() -> None:
    """Lets go of the tokenizers: a worker process lives on after its task, and other stages need its memory."""
    _whole.cache_clear()
    _by_word.cache_clear()


def pieces(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, part, size, nth[, ids]): nth counts the pieces of a size (in units) within a task."""
    with open(tokenizer_path, encoding="utf-8") as f:
        held = docs.sparkSession.sparkContext.broadcast(f.read())
    df = pick(docs, doc_id, text)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordTokenizer(held.value)
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity // UNIT + 2, np.int64)
        for b in batches:
            offsets, _ = buffers_of(b.column(1))
            for i, j in slices(offsets):
                ids, at = encoder.encode(b.column(1).slice(i, j - i), end)
                rows, starts, lengths, crcs, totals, sizes, nths, cut = [], [], [], [], [], [], [], []
                for k, (first, last) in enumerate(pairwise(at.tolist())):
                    total = last - first
                    for start in range(0, total, capacity):
                        piece = ids[first + start : min(last, first + start + capacity)]
                        length = len(piece)
                        size = -(-length // UNIT)
                        rows.append(i + k)
                        starts.append(start)
                        lengths.append(length)
                        crcs.append(zlib.crc32(piece))
                        totals.append(total)
                        sizes.append(size)
                        nths.append(int(seen[size]))
                        seen[size] += 1
                        if keep_ids:
                            cut.append(piece.astype(np.int64))
                columns = [b.column(0).take(pa.array(rows, pa.int64()))]
                columns += [pa.array(x, pa.int64()) for x in (starts, lengths, crcs, totals)] + [pa.array([part] * len(rows), pa.int32()), pa.array(sizes, pa.int32()), pa.array(nths, pa.int64())]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "size", "nth"]
                if keep_ids:
                    columns.append(pa.array(cut, pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)
        del encoder
        _forget()

    kind = df.schema[doc_id].dataType.simpleString()
    return map_batches(df, run, f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, part int, size int, nth bigint" + ", ids array<bigint>" * keep_ids)


def _dealing(plan: list[tuple[np.ndarray, int]]) -> list[tuple[int, int, int, int, int]]:
    """(size, first rank, rank after the last, pieces a sequence, first sequence) for each size of each pattern."""
    rows, given, sequence = [], {}, 0
    for counts, times in plan:
        for k in np.nonzero(counts)[0]:
            size, per = int(k) + 1, int(counts[k])
            first = given.get(size, 0)
            rows.append((size, first, first + per * times, per, sequence))
            given[size] = first + per * times
        sequence += times
    return rows


def pack(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]), a row for each piece.

    Every document, a null or empty text too, ends with end_id, so each has a piece at least. Repeated rows are packed as often as
    they occur; null ids stay null. sequence_id counts from 0 without gaps; within one, offsets have no gap.
    """
    if capacity % UNIT:
        raise ValueError(f"capacity must be a multiple of {UNIT}")
    spark = docs.sparkSession
    cut = settle(pieces(docs, tokenizer_path, doc_id, text, capacity, end_id, keep_ids))
    tally = cut.groupBy("size", "part").agg(F.count("*").alias("n"))
    demand = np.zeros(capacity // UNIT, np.int64)
    for size, n in tally.groupBy("size").agg(F.sum("n")).collect():
        demand[size - 1] = n
    dealing = spark.createDataFrame(_dealing(solve(demand, capacity // UNIT)), "size int, low bigint, high bigint, per bigint, first_sequence bigint")
    before = tally.select("size", "part", (F.sum("n").over(W.partitionBy("size").orderBy("part")) - F.col("n")).alias("before"))
    ranked = cut.join(before, ["size", "part"]).withColumn("rank", F.col("before") + F.col("nth"))
    at = F.col("rank") - F.col("low")
    dealt = ranked.join(F.broadcast(dealing.withColumnRenamed("size", "_size")), (F.col("size") == F.col("_size")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    dealt = dealt.withColumn("sequence_id", F.col("first_sequence") + F.floor(at / F.col("per")))
    offset = F.sum("length").over(W.partitionBy("sequence_id").orderBy(F.desc("size"), "rank").rowsBetween(W.unboundedPreceding, 0)) - F.col("length")
    return dealt.withColumn("offset", offset).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * keep_ids)
