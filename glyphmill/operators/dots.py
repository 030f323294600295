"""The best documents of each query by a sum of products of their weights, without a row for each pair.

Documents are read in Arrow batches, scored against blocks of the queries' weights as matrices, and each task keeps the k best of
every query: all pairs are scored, and what is shuffled is k rows a query and task.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.functions.storage import settle

#: Most queries of a block, most weights of its matrix, and documents scored at once.
BLOCK, WEIGHTS, BATCH = 4096, 1 << 23, 1024


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """x in units of its last kept digit, rounded half up by its shortest decimal form, as Spark's round does."""
    y = np.abs(x) * 10.0**digits
    low = np.floor(y)
    out = np.where(y - low < 0.5, low, low + 1)
    for i in np.nonzero(np.abs(y - low - 0.5) < 1e-4)[0]:
        out[i] = float(Decimal(repr(float(abs(x[i])))).scaleb(digits).quantize(Decimal(1), ROUND_HALF_UP))
    return np.copysign(out, x)


def vectors(rows: DataFrame, key: str = "doc_id", id_: str = "term_id", w: str = "w") -> DataFrame:
    """(key, ids, ws): the ids and weights of each key, ids ascending."""
    v = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(id_).cast("int").alias("i"), F.col(w).cast("double").alias("w")))).alias("v"))
    return v.select(key, F.transform("v", lambda x: x["i"]).alias("ids"), F.transform("v", lambda x: x["w"]).alias("ws"))


def _blocks(asked: pa.Table) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(query ids, term ids ascending, weights) of bounded size; the terms are those of the block's queries only."""
    column = [asked.column(c).combine_chunks() for c in ("ids", "ws")]
    ids, ws, at = column[0].flatten().to_numpy(), column[1].flatten().to_numpy(), np.concatenate([[0], np.cumsum(np.diff(column[0].offsets.to_numpy()))]).astype(np.int64)
    first = 0
    while first < asked.num_rows:
        n = min(BLOCK, asked.num_rows - first)
        while True:
            part = slice(at[first], at[first + n])
            terms = np.unique(ids[part])
            if n == 1 or n * len(terms) <= WEIGHTS:
                break
            n = (n + 1) // 2
        matrix = np.zeros((n, len(terms)))
        np.add.at(matrix, (np.repeat(np.arange(n), np.diff(at[first : first + n + 1])), np.searchsorted(terms, ids[part])), ws[part])
        yield asked.column("query_id").combine_chunks().slice(first, n), terms, matrix
        first += n


def _dense(ids: pa.Array, ws: pa.Array, terms: np.ndarray) -> np.ndarray:
    """Rows over the given terms; others are left out, repeated ones are summed."""
    i, w, row = ids.flatten().to_numpy(), ws.flatten().to_numpy(), np.repeat(np.arange(len(ids)), np.diff(ids.offsets.to_numpy()))
    at = np.minimum(np.searchsorted(terms, i), len(terms) - 1)
    held = terms[at] == i
    out = np.zeros((len(ids), len(terms)))
    np.add.at(out, (row[held], at[held]), w[held])
    return out


def _reach(ids: pa.Array, ws: pa.Array, terms: np.ndarray, near: np.ndarray) -> np.ndarray:
    """For each term the largest of a row's weights times its nearness, none being 0."""
    i, w, sizes = ids.flatten().to_numpy(), ws.flatten().to_numpy(), np.diff(ids.offsets.to_numpy())
    first, out = np.cumsum(sizes) - sizes, np.zeros((len(ids), len(terms)))
    columns = np.ascontiguousarray(near[terms].T)
    for r in range(int(sizes.max(initial=0))):
        rows = np.nonzero(sizes > r)[0]
        at = first[rows] + r
        out[rows] = np.maximum(out[rows], w[at, None] * columns[i[at]])
    return out


def _best(found: pa.Table, k: int, floor: np.ndarray) -> pa.Table:
    """The k best of each query, by unit descending and doc_id; floor takes the unit of each query's k-th."""
    found = found.take(pa.compute.sort_indices(found, [("q", "ascending"), ("less", "ascending"), ("doc_id", "ascending")], null_placement="at_start"))
    q = found.column("q").to_numpy()
    rank = np.arange(len(q)) - np.searchsorted(q, q)
    last = rank == k - 1
    floor[q[last]] = -found.column("less").to_numpy()[last]
    return found.filter(pa.array(rank < k))


class Best:
    """The k best documents of each query among those added, with what can be equal to them when rounded."""

    def __init__(self, n_queries: int, k: int, digits: int) -> None:
        self.k, self.digits, self.unit = k, digits, 10.0**-digits
        self.floor, self.found, self.waiting, self.kept = np.full(n_queries, -np.inf), [], 0, 0

    def add(self, scores: np.ndarray, doc_ids: pa.Array) -> None:
        """scores: a row for each query, a column for each document."""
        if scores.shape[1] >= self.k and np.isinf(self.floor).any():
            self._raise(scores)
        q, d = self._above(scores)
        if len(q) > 4 * self.k * len(scores) and scores.shape[1] >= self.k:
            self._raise(scores)
            q, d = self._above(scores)
        if not len(q):
            return
        value = scores[q, d]
        self.found.append(pa.table({"q": q, "less": -rounded(value, self.digits), "doc_id": doc_ids.take(pa.array(d)), "score": value}))
        self.waiting += len(q)
        if self.waiting > self.kept + 100_000:
            self.found = [_best(pa.concat_tables(self.found), self.k, self.floor)]
            self.waiting = self.kept = self.found[0].num_rows

    def _raise(self, scores: np.ndarray) -> None:
        """The k-th of these documents alone is a floor for those that follow."""
        at = scores.shape[1] - self.k
        np.maximum(self.floor, rounded(np.partition(scores, at, axis=1)[:, at], self.digits), out=self.floor)

    def _above(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # what is within two units of the k-th can be equal to it when rounded
        least = np.maximum((self.floor - 2) * self.unit, np.nextafter(0.0, 1.0))
        return np.divmod(np.flatnonzero(scores >= least[:, None]), max(1, scores.shape[1]))

    def table(self) -> pa.Table | None:
        return _best(pa.concat_tables(self.found), self.k, self.floor) if self.found else None


def top(queries: DataFrame, docs: DataFrame, k: int, digits: int = 6, near: np.ndarray | None = None) -> DataFrame:
    """(query_id, doc_id, score): the pairs of positive score that can be among the k best of a query, ties by doc_id, before they are
    ranked as a whole.

    queries and docs have (query_id or doc_id, ids, ws), one row each. Scores are sums over shared ids; with near, a matrix over ids, a
    document's weight of an id is the largest of its own weights times nearness. The driver holds the queries' weights and sends
    them out in blocks of bounded size; documents are never collected.
    """
    asked = queries.select("query_id", "ids", "ws").toArrow()
    spark, kinds = docs.sparkSession, {c: d.schema[c].dataType.simpleString() for d, c in ((queries, "query_id"), (docs, "doc_id"))}
    schema = f"query_id {kinds['query_id']}, doc_id {kinds['doc_id']}, score double"
    blocks = [b for b in _blocks(asked) if len(b[1])]
    if not blocks:
        return spark.createDataFrame([], schema)
    if len(blocks) > 1:
        docs = settle(docs.select("doc_id", "ids", "ws"))

    def scored(block: tuple[pa.Array, np.ndarray, np.ndarray]) -> DataFrame:
        held = spark.sparkContext.broadcast((block, near))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import pyarrow.compute  # noqa: F401

            (names, terms, weights), nearness = held.value
            best = Best(len(names), k, digits)
            for b in batches:
                for start in range(0, b.num_rows, BATCH):
                    part = b.slice(start, BATCH)
                    # a slice's flat values are its own, its offsets are not
                    ids, ws = pa.concat_arrays([part.column(1)]), pa.concat_arrays([part.column(2)])
                    ids = pa.ListArray.from_arrays(pa.array(ids.offsets.to_numpy() - ids.offsets[0].as_py(), pa.int32()), ids.flatten())
                    ws = pa.ListArray.from_arrays(ids.offsets, ws.flatten())
                    best.add(weights @ (_dense(ids, ws, terms) if nearness is None else _reach(ids, ws, terms, nearness)).T, part.column(0))
            if (out := best.table()) is not None:
                yield from pa.table({"query_id": names.take(out.column("q").combine_chunks()), "doc_id": out.column("doc_id"), "score": out.column("score")}).to_batches(10_000)

        return docs.select("doc_id", "ids", "ws").mapInArrow(run, schema)

    return reduce(DataFrame.unionAll, [scored(b) for b in blocks])
