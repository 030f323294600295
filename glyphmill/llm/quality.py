"""Document quality from a linear-chain conditional random field over lines.

Each line is good or bad. Its features are counts of its own characters and words and those of its neighbouring lines; the field's
forward-backward marginals, weighted by line length, give a document's share of good text, and a logistic curve fitted on the same
sample turns that share into a score. Labels are of documents, so lines of a bad document start as bad and are relabelled by the
field itself: a line that looks good becomes good, though the worst line of a bad document stays bad.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.crf import Batch, Chain, fit, marginals, minimise
from glyphmill.llm.rows import buffers_of, held_out, map_batches, pick, settle, slices

#: The field is fitted on at most so many labelled documents, those with the smallest hash of their id, and on at most so many
#: lines of each, in stretches that a hash chooses from the whole text. The logistic curve is fitted on those documents' whole texts,
#: and scoring reads every line of every document.
MAX_LABELLED = 4000
MAX_LINES, STRETCH = 200, 25
THRESHOLD = 0.7


def _among(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SPACE, _SYMBOL, _UPPER, _LOWER = _among(b" \t\n\x0b\x0c\r"), _among(b"#*$%&|<>@^~{}[]\\"), _among(bytes(range(65, 91))), _among(bytes(range(97, 123)))
_DIGIT, _PUNCT, _LOUD, _HIGH, _BAR, _TAIL = _among(bytes(range(48, 58))), _among(b".,;:?"), _among(b"!"), _among(bytes(range(192, 256))), _among(b"|"), _among(bytes(range(128, 192)))
_MIX = np.random.default_rng(7).integers(1, 1 << 62, 256, dtype=np.uint64) | np.uint64(1)
N_OWN = 14


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts in `data` between `offsets`: features of every line that has a word, its length in characters, lines of each text."""
    n_docs = len(offsets) - 1
    base = offsets[0]
    d, offs = data[base : offsets[-1]], offsets - base
    feeds = np.nonzero(d == 10)[0]
    starts = np.union1d(offs[:-1][offs[:-1] < offs[1:]], (feeds + 1)[feeds + 1 < len(d)]).astype(np.int64)
    ends = np.append(starts[1:], len(d))
    of = np.searchsorted(offs, starts, side="right") - 1

    def upto(mask: np.ndarray) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(mask, dtype=np.int32)])

    solid = ~_SPACE[d]
    opens = solid.copy()
    opens[1:] &= ~solid[:-1]
    opens[starts] = solid[starts]
    words = upto(opens)
    some = words[ends] > words[starts]
    starts, ends, of = starts[some], ends[some], of[some]
    if not len(starts):
        return np.zeros((0, N_OWN)), np.zeros(0), np.zeros(n_docs, np.int64)

    def count(mask: np.ndarray) -> np.ndarray:
        c = upto(mask)
        return (c[ends] - c[starts]).astype(np.float64)

    n = (words[ends] - words[starts]).astype(np.float64)
    chars = count(solid & ~_TAIL[d])
    letters = np.maximum(count(_UPPER[d] | _LOWER[d] | _HIGH[d]), 1)
    at = np.nonzero(opens)[0]
    mixed = _MIX[d]
    mixed[~solid] = 0
    s1 = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed)])
    s2 = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed * np.arange(1, len(d) + 1, dtype=np.uint64))])
    close = np.append(at[1:], len(d))
    print_of = (s2[close] - s2[at]) - at.astype(np.uint64) * (s1[close] - s1[at])
    line = np.searchsorted(starts, at, side="right") - 1
    same = np.zeros(len(at), bool)
    same[1:] = (print_of[1:] == print_of[:-1]) & (line[1:] == line[:-1])
    again = np.bincount(line[same], minlength=len(starts))
    key = (print_of + line.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    order = np.argsort(key)
    fresh = np.ones(len(at), bool)
    fresh[1:] = key[order][1:] != key[order][:-1]
    distinct = np.bincount(line[order][fresh], minlength=len(starts))
    seal = (s2[ends] - s2[starts]) - starts.astype(np.uint64) * (s1[ends] - s1[starts])
    by = np.lexsort((np.arange(len(seal)), seal, of))
    earlier = np.zeros(len(seal), bool)
    earlier[by[1:]] = (seal[by[1:]] == seal[by[:-1]]) & (of[by[1:]] == of[by[:-1]])
    symbols = count(_SYMBOL[d])
    x = np.stack(
        [
            np.minimum(np.log1p(n) / 5, 2),
            np.minimum(chars / n / 10, 3),
            np.minimum(symbols / n, 3),
            count(_UPPER[d]) / letters,
            count(_DIGIT[d]) / np.maximum(chars, 1),
            np.minimum(count(_PUNCT[d]) / n, 3),
            np.minimum(count(_LOUD[d]) / n, 3),
            np.minimum(count(_BAR[d]) / n, 2),
            again / n,
            distinct / n,
            earlier.astype(np.float64),
            count(_HIGH[d]) / np.maximum(chars, 1),
            _UPPER[d[starts]].astype(np.float64),
            (symbols > 0).astype(np.float64),
        ],
        1,
    )
    return x, chars, np.bincount(of, minlength=n_docs)


def with_neighbours(x: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """A line's own features, those of the line before and after (zeros where there is none), which of the two exist, and 1."""
    lines = lines[lines > 0]
    ends = np.cumsum(lines) - 1
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    has_before, has_after = np.ones((len(x), 1)), np.ones((len(x), 1))
    if len(lines):
        has_before[ends - lines + 1] = 0
        has_after[ends] = 0
    return np.concatenate([x, before * has_before, after * has_after, has_before, has_after, np.ones((len(x), 1))], 1)


def _per_text(values: np.ndarray, lines: np.ndarray) -> np.ndarray:
    c = np.concatenate([[0.0], np.cumsum(values)])
    ends = np.cumsum(lines)
    return c[ends] - c[ends - lines]


@dataclass
class Model:
    """State 1 is good."""

    chain: Chain
    slope: float
    bias: float

    def good_share(self, x: np.ndarray, chars: np.ndarray, lines: np.ndarray) -> np.ndarray:
        """Marginals of good, weighted by length; texts without a line have none."""
        m = marginals(self.chain.emissions(with_neighbours(x, lines)), self.chain, Batch(lines))[0][:, 1] if len(x) else np.zeros(0)
        return _per_text(m * chars, lines) / np.maximum(_per_text(chars, lines), 1)

    def score(self, share: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * _stretch(share) + self.bias, -30, 30)))


def _stretch(share: np.ndarray) -> np.ndarray:
    """Spreads shares near 1, where documents of little bad text lie."""
    return -np.log10(np.clip(1 - share, 0, 1) + 1e-3)


def fit_lines(x: np.ndarray, lines: np.ndarray, of: np.ndarray, good: np.ndarray, rounds: int = 3) -> Chain | None:
    """The field from stretches of lines: features with neighbours, lines of each stretch, its document, and the documents' labels.

    Without lines of both labels there is none.
    """
    line_of = np.repeat(of, lines)
    if not len(x) or good[line_of].all() or not good[line_of].any():
        return None
    states = good[line_of].astype(np.int64)
    for _ in range(rounds):
        chain = fit(x, states, lines, 2)
        m = marginals(chain.emissions(x), chain, Batch(lines))[0][:, 1]
        low = np.full(len(good), np.inf)
        np.minimum.at(low, line_of, m)
        states = np.where(good[line_of], 1, (m > 0.5) & (m > low[line_of])).astype(np.int64)
    return chain


def calibrate(chain: Chain | None, share: np.ndarray, good: np.ndarray) -> Model:
    """The logistic curve from whole documents' shares to their labels; without a field every document gets the same score."""
    if chain is None:
        rate = (good.sum() + 1) / (len(good) + 2)
        return Model(Chain(np.zeros((3 * N_OWN + 3, 2)), np.zeros((2, 2)), np.zeros(2)), 0.0, float(np.log(rate / (1 - rate))))
    z = _stretch(share)

    def loss(v: np.ndarray) -> tuple[float, np.ndarray]:
        t = v[0] * z + v[1]
        p = 1 / (1 + np.exp(-np.clip(t, -30, 30)))
        g = p - good
        return float((np.logaddexp(0, t) - good * t).sum() + 1e-2 * v[0] ** 2), np.array([g @ z + 2e-2 * v[0], g.sum()])

    slope, bias = (float(v) for v in minimise(loss, np.zeros(2)))
    return Model(chain, slope, bias)


def stretches(n: int, seed: int, most: int, size: int = STRETCH) -> list[tuple[int, int]]:
    """Parts of n lines, at most `most` in all: the whole, or parts of `size` lines that a hash of the seed and their place chooses."""
    if n <= most:
        return [(0, n)] if n else []
    at = sorted(range(0, n, size), key=lambda i: (zlib.crc32(f"{seed}:{i}".encode()), i))[: max(1, most // size)]
    return [(i, min(n, i + size)) for i in sorted(at)]


def learn_from(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", max_labelled: int = MAX_LABELLED, max_lines: int = MAX_LINES) -> Model:
    """Fits on labelled documents outside the held-out fold; of rows that repeat a doc_id the one with the smallest text counts."""
    chosen = pick(labels, doc_id, label).where(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(doc_id))
    chosen = chosen.groupBy(doc_id).agg(F.min(label).alias("_label")).orderBy(F.xxhash64(doc_id), doc_id).limit(max_labelled)
    sample = pick(docs, doc_id, text).join(F.broadcast(chosen), doc_id).groupBy(F.xxhash64(doc_id).alias("h")).agg(F.min(F.struct(F.col("_label").cast("int").alias("good"), F.col(text).alias("text"))).alias("x"))
    sample = settle(sample.select("h", "x.good", "x.text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            offsets, data = buffers_of(b.column(2))
            for i, j in slices(offsets):
                x, _, lines = line_features(data, offsets[i : j + 1])
                full = with_neighbours(x, lines).astype(np.float32)
                begins = np.cumsum(lines) - lines
                for k, h in enumerate(b.column(0).slice(i, j - i).to_pylist()):
                    some = [full[begins[k] + a : begins[k] + e] for a, e in stretches(int(lines[k]), h, max_lines)]
                    yield pa.RecordBatch.from_arrays([pa.array([v] * len(some), t) for v, t in ((h, pa.int64()), (b.column(1)[i + k].as_py(), pa.int32()))] + [pa.array(range(len(some)), pa.int32()), pa.array([x.ravel() for x in some], pa.list_(pa.float32()))], ["h", "good", "nth", "x"])

    rows = map_batches(sample, cut, "h bigint, good int, nth int, x array<float>").toArrow().sort_by([("h", "ascending"), ("nth", "ascending")])
    if not rows.num_rows:
        return calibrate(None, np.zeros(0), np.array([r.good == 1 for r in sample.select("good").collect()], bool))
    ids, first, of = np.unique(rows["h"].to_numpy(), return_index=True, return_inverse=True)
    x = rows["x"].combine_chunks()
    lines = np.diff(x.offsets.to_numpy()) // (3 * N_OWN + 3)
    chain = fit_lines(x.flatten().to_numpy().reshape(-1, 3 * N_OWN + 3), lines, of, rows["good"].to_numpy()[first] == 1)
    del x, rows
    held = sample.sparkSession.sparkContext.broadcast(chain)

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(held.value, 1.0, 0.0) if held.value is not None else None
        for b in batches:
            offsets, data = buffers_of(b.column(2))
            for i, j in slices(offsets):
                share = model.good_share(*line_features(data, offsets[i : j + 1])) if model else np.zeros(j - i)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array(share)], ["h", "good", "share"])

    whole = map_batches(sample, shares, "h bigint, good int, share double").toArrow().sort_by("h")
    return calibrate(chain, whole["share"].to_numpy(), whole["good"].to_numpy() == 1)


def score(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = THRESHOLD, max_labelled: int = MAX_LABELLED, max_lines: int = MAX_LINES
) -> DataFrame:
    """(doc_id, held_out, score, predicted, good_share), a row for each input row.

    Only text enters a score. Texts that are null, empty or have no word have a good share of 0. Rows labelled null are not learned
    from; a document labelled twice counts as bad if either label is. Repeated rows stay; a null doc_id counts as an empty text in
    the fold's checksum.
    """
    held = docs.sparkSession.sparkContext.broadcast(learn_from(docs, labels, doc_id, text, label, max_labelled, max_lines))
    df = pick(docs, doc_id, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for b in batches:
            offsets, data = buffers_of(b.column(1))
            for i, j in slices(offsets):
                share = model.good_share(*line_features(data, offsets[i : j + 1]))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(model.score(share)), pa.array(share)], ["doc_id", "score", "good_share"])

    scored = map_batches(df, run, f"doc_id {df.schema[doc_id].dataType.simpleString()}, score double, good_share double")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "good_share")
