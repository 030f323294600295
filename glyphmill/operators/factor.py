"""TF-IDF, sparse dictionaries and non-negative factors, and ranking on atoms.

Terms are counted within the documents' tasks, so no row for a document's term is shuffled. Dictionaries and factors are fitted on every
document: in each round tasks code their documents against the broadcast atoms and sum what the next atoms need, and the driver holds
the atoms and these sums only, n_atoms by max_features whatever the corpus holds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glyphmill.functions import tokens
from glyphmill.functions.storage import settle
from glyphmill.operators import dots
from glyphmill.operators.bm25 import counts_in, ranked
from glyphmill.operators.energy import concept_graph, diffuse, genericity

MIN_DF, MAX_DF, MAX_FEATURES = 2, 0.95, 10_000
#: Documents of a block, which are coded at once, and pieces in which sums over blocks are dealt.
BLOCK, PIECES = 1024, 16
#: A dictionary begins with documents that are least alike among so many for each atom; what it becomes is learned from all.
SPARE = 4
#: Atoms that are solved for between two products with all codes.
GROUP = 32


def _terms(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, terms), one row for each doc_id: rows of one id are one document, and only then is anything shuffled but ids."""
    t = docs.select(F.col(doc_id).alias("doc_id"), tokens.vector_terms(F.col(text)).alias("terms"))
    if docs.groupBy(doc_id).agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        t = t.groupBy("doc_id").agg(F.flatten(F.collect_list("terms")).alias("terms"))
    return t


def term_totals(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(term, df, total): documents that hold each term, and how often it occurs. Tasks count by batch, and batches are added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = b.column(0)
            coded = words.flatten().dictionary_encode()
            codes, width = coded.indices.to_numpy().astype(np.int64), max(1, len(coded.dictionary))
            pairs = np.unique(np.repeat(np.arange(len(words)), np.diff(words.offsets.to_numpy())) * width + codes)
            counts = [np.bincount(c, minlength=len(coded.dictionary)) for c in (pairs % width, codes)]
            yield pa.RecordBatch.from_arrays([coded.dictionary, *[pa.array(c, pa.int64()) for c in counts]], ["term", "df", "total"])

    part = _terms(docs, doc_id, text).select("terms").mapInArrow(run, "term string, df bigint, total bigint")
    return part.groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_df: int = MIN_DF, max_df: float = MAX_DF, max_features: int = MAX_FEATURES) -> DataFrame:
    """(term_id, term, idf): terms in at least min_df documents and at most a share of max_df, the most frequent ones; ids by term."""
    n = docs.agg(F.count("*").alias("n_docs"))
    t = term_totals(docs, doc_id, text).crossJoin(F.broadcast(n))
    t = t.where((F.col("df") >= min_df) & (F.col("df") <= max_df * F.col("n_docs"))).orderBy(F.desc("total"), "term").limit(max_features)
    idf = F.log((F.col("n_docs") + 1) / (F.col("df") + 1)) + 1
    return t.select((F.row_number().over(W.orderBy("term")) - 1).alias("term_id"), "term", idf.alias("idf"))


def vectors(docs: DataFrame, vocabulary_: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids, ws): a document's terms and weights as arrays, ids ascending: sublinear term frequency times idf, each document of
    length 1; a document without a term of the vocabulary has no row. The vocabulary has max_features rows at most and goes to every task."""
    v = vocabulary_.select("term_id", "term", "idf").orderBy("term_id").toArrow()
    kind = docs.schema[doc_id].dataType.simpleString()
    if not v.num_rows:
        return docs.sparkSession.createDataFrame([], f"doc_id {kind}, ids array<int>, ws array<double>")
    sent = docs.sparkSession.sparkContext.broadcast((v["term_id"].to_numpy(), v["term"].combine_chunks(), v["idf"].to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, known, idf = sent.value
        for b in batches:
            row, ids, tfs = counts_in(b.column(1), known)
            x = (np.log(tfs) + 1) * idf[ids]
            w = x / np.sqrt(np.bincount(row, x * x, b.num_rows))[row]
            held, first = np.unique(row, return_index=True)
            offsets = pa.array(np.append(first, len(row)), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(c, t)) for c, t in ((numbers[ids], pa.int32()), (w, pa.float64()))]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(held)), *lists], ["doc_id", "ids", "ws"])

    return _terms(docs, doc_id, text).mapInArrow(run, f"doc_id {kind}, ids array<int>, ws array<double>")


def tfidf(docs: DataFrame, vocabulary_: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, term_id, w): the entries of vectors(), a row each."""
    return vectors(docs, vocabulary_, doc_id, text).select("doc_id", F.explode(F.arrays_zip("ids", "ws")).alias("x")).select("doc_id", F.col("x.ids").alias("term_id"), F.col("x.ws").alias("w"))


def _dense(ids: pa.Array, ws: pa.Array, width: int) -> np.ndarray:
    sizes = np.diff(ids.offsets.to_numpy())
    out = np.zeros((len(ids), width), np.float32)
    out[np.repeat(np.arange(len(ids)), sizes), ids.flatten().to_numpy()] = ws.flatten().to_numpy()
    return out


def code(x: np.ndarray, atoms: np.ndarray, alpha: float, sweeps: int = 50, tolerance: float = 1e-5) -> np.ndarray:
    """Non-negative codes of least (1/2)|x - h D|^2 + alpha |h|, by coordinate descent over the atoms, for all rows at once."""
    return _solve(atoms @ atoms.T, atoms @ x.T - np.asarray(alpha, x.dtype), sweeps, tolerance).T


def _solve(gram: np.ndarray, target: np.ndarray, sweeps: int, tolerance: float, h: np.ndarray | None = None) -> np.ndarray:
    """Non-negative h of least (1/2) h' gram h - h' target for each column of the target, from h or else from 0."""
    h = np.zeros_like(target) if h is None else h.copy()
    diagonal = np.maximum(np.diag(gram), 1e-12)
    for _ in range(sweeps):
        most = 0.0
        for first in range(0, len(gram), GROUP):
            # what is left for a group of atoms is one product, and is kept up to date as each of them moves
            end = min(first + GROUP, len(gram))
            left = target[first:end] - gram[first:end] @ h
            for j in range(first, end):
                new = np.maximum(0, h[j] + left[j - first] / diagonal[j])
                step = new - h[j]
                moved = float(np.abs(step).max(initial=0))
                if moved:
                    h[j] = new
                    left[j - first + 1 :] -= gram[j + 1 : end, j, None] * step
                    most = max(most, moved)
        if most < tolerance:
            break
    return h


def _apart(x: np.ndarray, n: int) -> np.ndarray:
    """n of the rows, of length 1, each the least like those before it."""
    picked, near = [0], x @ x[0]
    while len(picked) < n:
        picked.append(int(np.argmin(near)))
        near = np.maximum(near, x @ x[picked[-1]])
        near[picked] = np.inf
    return x[picked].astype(np.float64)


class Local:
    """Documents as the rows of one matrix."""

    def __init__(self, x: np.ndarray):
        self.x, self.n, self.width = x, *x.shape

    def some(self, n: int) -> np.ndarray:
        return self.x[np.random.default_rng(42).choice(self.n, n, replace=False)]

    def total(self, of: Callable[..., np.ndarray], *model: np.ndarray) -> np.ndarray:
        return sum(of(self.x[at : at + BLOCK].astype(np.float32), *model) for at in range(0, self.n, BLOCK))


class Spread:
    """Documents as blocks in the cluster, packed once; (doc_id, ids, ws) are settled."""

    def __init__(self, vectors_: DataFrame, width: int):
        self.vectors, self.n, self.width = vectors_, vectors_.count(), width
        self.spark = vectors_.sparkSession

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, b.num_rows, BLOCK):
                    ids, ws = (pa.concat_arrays([b.column(c).slice(at, BLOCK)]) for c in (0, 1))
                    parts = (np.diff(ids.offsets.to_numpy()).astype(np.int32), ids.flatten().to_numpy().astype(np.int32), ws.flatten().to_numpy().astype(np.float32))
                    yield pa.RecordBatch.from_arrays([pa.array([p.tobytes()], pa.binary()) for p in parts], ["sizes", "ids", "ws"])

        # as many tasks as there are cores, since each hands on sums as large as the atoms
        tasks = max(1, min(self.spark.sparkContext.defaultParallelism, -(-self.n // BLOCK)))
        self.blocks = settle(vectors_.select("ids", "ws").mapInArrow(pack, "sizes binary, ids binary, ws binary").repartition(tasks))

    def some(self, n: int) -> np.ndarray:
        """The documents of the smallest hashes of their ids, to begin with."""
        t = self.vectors.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n).select("ids", "ws").toArrow()
        return _dense(t["ids"].combine_chunks(), t["ws"].combine_chunks(), self.width)

    def total(self, of: Callable[..., np.ndarray], *model: np.ndarray) -> np.ndarray:
        """of(block, *model), a flat array, summed over all blocks: in each task first, then by pieces of it."""
        sent, width = self.spark.sparkContext.broadcast([m.astype(np.float32) for m in model]), self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = None
            for b in batches:
                for sizes, ids, ws in zip(*b.columns, strict=True):
                    sizes, ids, ws = (np.frombuffer(v.as_buffer(), t) for v, t in ((sizes, np.int32), (ids, np.int32), (ws, np.float32)))
                    x = np.zeros((len(sizes), width), np.float32)
                    x[np.repeat(np.arange(len(sizes)), sizes), ids] = ws
                    got = of(x, *sent.value)
                    out = got.astype(np.float64) if out is None else np.add(out, got, out)
            if out is not None:
                for k, piece in enumerate(np.array_split(out.astype(np.float32), PIECES)):
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([piece.tobytes()], pa.binary())], ["k", "piece"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for b in batches:
                for k, piece in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    sums[k] = sums.get(k, 0.0) + np.frombuffer(piece.as_buffer(), np.float32).astype(np.float64)
            for k, x in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([x.astype(np.float32).tobytes()], pa.binary())], ["k", "piece"])

        kinds = "k int, piece binary"
        found = self.blocks.mapInArrow(run, kinds).repartition(PIECES, "k").mapInArrow(add, kinds).toArrow()
        sent.unpersist()
        pieces = dict(zip(found["k"].to_pylist(), (v.as_buffer() for v in found["piece"]), strict=True))
        return np.concatenate([np.frombuffer(pieces[k], np.float32) for k in range(PIECES)]).astype(np.float64)


def _coded(x: np.ndarray, atoms: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    """Flat, of a block: h h', h x and the objective, where h are the codes (atoms by documents)."""
    gram, target = atoms @ atoms.T, atoms @ x.T
    h = _solve(gram, target - alpha, 20, 1e-3)
    lost = 0.5 * float((x * x).sum()) - float((h * target).sum()) + 0.5 * float((h * (gram @ h)).sum()) + float(alpha) * float(h.sum())
    return np.concatenate([(h @ h.T).ravel(), (h @ x).ravel(), [lost]])


def _alternate(docs: Local | Spread, atoms: np.ndarray, alpha: float, rounds: int, tolerance: float, update: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Codes of all documents and new atoms in turn, until a round lessens the objective by a share below the tolerance."""
    k, last = len(atoms), np.inf
    for _ in range(max(rounds, 1)):
        sums = docs.total(_coded, atoms, np.array(alpha))
        a, b, lost = sums[: k * k].reshape(k, k), sums[k * k : -1].reshape(k, -1), sums[-1]
        atoms = update(atoms, a, b)
        if last - lost < tolerance * abs(lost):
            break
        last = lost
    return atoms


def learn_dictionary(x: np.ndarray | Spread, n_atoms: int = 256, alpha: float = 0.1, rounds: int = 100, tolerance: float = 1e-3) -> np.ndarray:
    """Positive atoms of length 1 at most, of all documents: sums of h h' and h x, and updates of single atoms, in turn."""
    docs = x if isinstance(x, Spread) else Local(x)
    n_atoms = min(n_atoms, max(1, docs.n))
    atoms = _apart(docs.some(min(docs.n, SPARE * n_atoms)), n_atoms)
    atoms += np.random.default_rng(42).random(atoms.shape) * 1e-4
    atoms /= np.maximum(np.linalg.norm(atoms, axis=1, keepdims=True), 1e-12)

    def update(atoms: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        for first in [*range(0, len(atoms), GROUP)] * 3:
            end = min(first + GROUP, len(atoms))
            left = b[first:end] - a[first:end] @ atoms
            for j in range(first, end):
                if a[j, j] > 1e-10:
                    atom = np.maximum(0, atoms[j] + left[j - first] / a[j, j])
                    atom /= max(1.0, float(np.linalg.norm(atom)))
                    left[j - first + 1 :] -= a[j + 1 : end, j, None] * (atom - atoms[j])
                    atoms[j] = atom
        return atoms

    return _alternate(docs, atoms, alpha, rounds, tolerance, update)


def learn_factors(x: np.ndarray | Spread, n_basis: int = 128, rounds: int = 200, tolerance: float = 1e-4) -> np.ndarray:
    """Non-negative basis rows of x = h W, of all documents, by least squares in turn, started from the singular vectors' larger halves.

    The singular vectors come from rounds of subspace iteration over the documents.
    """
    docs = x if isinstance(x, Spread) else Local(x)
    n_basis = min(n_basis, docs.n, docs.width)
    v = np.linalg.qr(np.random.default_rng(42).normal(size=(docs.width, min(n_basis + 10, docs.width))))[0]
    for _ in range(SUBSPACE):
        z = docs.total(lambda x, v: (x.T @ (x @ v)).ravel(), v).reshape(v.shape)
        values, turn = np.linalg.eigh(v.T @ z)
        v, before = np.linalg.qr(z)[0], v @ turn[:, ::-1]
    v = before[:, :n_basis]
    halves = docs.total(lambda x, v: np.concatenate([(np.maximum(s * (x @ v), 0) ** 2).sum(0) for s in (1, -1)]), v).reshape(2, n_basis)
    both = [(np.sqrt(halves[i]) * np.linalg.norm(np.maximum(sign * v, 0), axis=0), np.maximum(sign * v, 0)) for i, sign in enumerate((1, -1))]
    w = np.where(both[0][0] >= both[1][0], both[0][1], both[1][1]).T.copy()
    w *= np.sqrt(np.maximum(values[::-1][:n_basis], 0))[:, None] > 1e-6
    return _alternate(docs, w, 0.0, rounds, tolerance, lambda w, a, b: _solve(a, b, 20, 1e-6, w))


#: Rounds of subspace iteration.
SUBSPACE = 5


def affinity(atoms: np.ndarray) -> np.ndarray:
    unit = atoms / np.maximum(np.linalg.norm(atoms, axis=1, keepdims=True), 1e-12)
    return unit @ unit.T


def atom_statistics(atoms: np.ndarray) -> dict[str, float]:
    """Off-diagonal affinity: mean (over all places), largest, share above 0.1."""
    a = affinity(atoms) - np.eye(len(atoms))
    return {"mean": float(a.mean()), "max": float(a.max()), "share": float((a > 0.1).mean())}


def encode(vectors_: DataFrame, atoms: np.ndarray, alpha: float = 0.1, top: int | None = None, batch: int = 512) -> DataFrame:
    """(doc_id, rnk, atom, value): the codes of documents, the `top` largest of each (ties by atom), else all that are positive."""
    held = vectors_.sparkSession.sparkContext.broadcast(atoms.astype(np.float64))
    kind = vectors_.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = held.value
        keep = min(top, len(d)) if top else len(d)
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                h = code(_dense(part.column(1), part.column(2), d.shape[1]).astype(np.float64), d, alpha)
                order = np.argsort(-h, axis=1, kind="stable")[:, :keep]
                value = np.take_along_axis(h, order, 1)
                rows, rank = np.nonzero(np.ones_like(value, bool) if top else value > 0)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(rows)), pa.array(rank + 1, pa.int32()), pa.array(order[rows, rank], pa.int32()), pa.array(value[rows, rank])], ["doc_id", "rnk", "atom", "value"]
                )

    return vectors_.mapInArrow(run, f"doc_id {kind}, rnk int, atom int, value double")


def atom_idf(doc_atoms: DataFrame, n_docs: int, positive: bool = False) -> DataFrame:
    """(atom, idf): ln((N + 1) / (c + 1)) + 1, where c counts all stored codes, or the positive ones."""
    kept = doc_atoms.where("value > 0") if positive else doc_atoms
    return kept.groupBy("atom").agg(F.count("*").alias("c")).select("atom", (F.log((n_docs + 1.0) / (F.col("c") + 1.0)) + 1).alias("idf"))


def gate(query_atoms: DataFrame, k: int) -> DataFrame:
    """The k largest positive codes of each query."""
    q = query_atoms.where("value > 0")
    return q.withColumn("rk", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("value"), "atom"))).where(F.col("rk") <= k).select("query_id", "atom", "value")


def above_document_mean(doc_atoms: DataFrame, n_basis: int) -> DataFrame:
    """Codes less the mean of their document over all n_basis, where more than that."""
    less = F.col("value") - F.sum("value").over(W.partitionBy("doc_id")) / n_basis
    return doc_atoms.withColumn("value", less).where("value > 0")


def maxsim(query_atoms: DataFrame, doc_atoms: DataFrame, affinity_: DataFrame, idf: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, doc_id, score): for each query atom the best of document code times affinity, weighted by code and idf, summed.

    affinity_ (a, b, sim) and idf are as large as the square of the number of atoms at most.
    """
    weighted = query_atoms.join(F.broadcast(idf), "atom", "left").select("query_id", "atom", (F.col("value") * F.coalesce("idf", F.lit(1.0))).alias("weight"))
    pairs = affinity_.select("a", "b", "sim").toArrow()
    width = 1 + max([0, *(int(np.max(pairs[c].to_numpy(), initial=0)) for c in ("a", "b"))])
    near = np.zeros((width, width))
    near[pairs["a"].to_numpy(), pairs["b"].to_numpy()] = pairs["sim"].to_numpy()
    known = lambda rows: rows.where(F.col("atom").between(0, width - 1))
    found = dots.top(_queries(known(weighted)), _codes(known(doc_atoms)), k, near=near)
    return ranked(found, k).select("query_id", "rank", "doc_id", "score")


def _queries(weighted: DataFrame) -> DataFrame:
    return dots.vectors(weighted, "query_id", "atom", "weight")


def _codes(doc_atoms: DataFrame) -> DataFrame:
    return dots.vectors(doc_atoms.where("value > 0"), "doc_id", "atom", "value")


def gated_dot(query_atoms: DataFrame, doc_atoms: DataFrame, idf: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, doc_id, score): weighted query codes times document codes."""
    q = query_atoms.join(F.broadcast(idf), "atom", "left").select("query_id", "atom", (F.col("value") * F.coalesce("idf", F.lit(1.0))).alias("weight"))
    found = dots.top(_queries(q), dots.vectors(doc_atoms, "doc_id", "atom", "value"), k)
    return ranked(found, k).select("query_id", "rank", "doc_id", "score")


def diffused_dot(query_atoms: DataFrame, doc_atoms: DataFrame, idf: DataFrame, n_docs: int, k: int = 10, iterations: int = 2, damping: float = 0.6) -> DataFrame:
    """Query codes times idf, diffused over the graph of atoms that documents share, times idf and genericity, dotted with the codes."""
    held = doc_atoms.where("value > 0")
    graph = concept_graph(held.select("doc_id", F.col("atom").alias("cid")))
    share = held.groupBy("atom").agg((F.count("*") / F.lit(float(max(1, n_docs)))).alias("share"))
    e = query_atoms.join(F.broadcast(idf), "atom").select("query_id", F.col("atom").alias("cid"), (F.col("value") * F.col("idf")).alias("energy"))
    out = diffuse(e, graph, iterations, damping, dangling=False).withColumnRenamed("cid", "atom")
    q = out.join(F.broadcast(share), "atom").select("query_id", "atom", (F.col("energy") * genericity(F.col("share"))).alias("value"))
    return gated_dot(q, held, idf, k)


@dataclass
class Retriever:
    """Dictionary atoms and MaxSim: fit once, search in batches."""

    n_atoms: int = 256
    top_k_query: int = 10
    top_m_doc: int = 15
    alpha: float = 0.1
    max_features: int = MAX_FEATURES
    method: str = "dictionary"
    rounds: int = 100

    def fit(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Retriever:
        spark = docs.sparkSession
        self.n_docs = docs.count()
        self.vocabulary = settle(vocabulary(docs, doc_id, text, max_features=self.max_features))
        self.vectors = settle(vectors(docs, self.vocabulary, doc_id, text))
        held = Spread(self.vectors, self.vocabulary.count())
        if not held.n:
            raise ValueError("no document has a term of the vocabulary")
        self.atoms = learn_dictionary(held, self.n_atoms, self.alpha, self.rounds) if self.method == "dictionary" else learn_factors(held, self.n_atoms)
        a = affinity(self.atoms)
        self.affinity = spark.createDataFrame([(int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a > 0), strict=True)], "a int, b int, sim double")
        self.doc_atoms = encode(self.vectors, self.atoms, self.alpha if self.method == "dictionary" else 0.0, min(self.top_m_doc, len(self.atoms)))
        self.doc_atoms = settle(self.doc_atoms)
        self.idf = atom_idf(self.doc_atoms, self.n_docs, positive=self.method != "dictionary").cache()
        return self

    def query_atoms(self, queries: DataFrame) -> DataFrame:
        if not hasattr(self, "atoms"):
            raise RuntimeError("fit() comes before search")
        v = vectors(queries.select(F.col("query_id").alias("doc_id"), F.col("query_text").alias("text")), self.vocabulary)
        codes = encode(v, self.atoms, self.alpha if self.method == "dictionary" else 0.0).withColumnRenamed("doc_id", "query_id")
        return gate(codes, self.top_k_query)

    def search(self, queries: DataFrame, k: int = 10, ranking: str = "maxsim") -> DataFrame:
        """queries: (query_id, query_text); ranking: maxsim, gated or diffused. A query without an atom has no results."""
        q = self.query_atoms(queries)
        if ranking == "gated":
            return gated_dot(q, above_document_mean(self.doc_atoms, len(self.atoms)), self.idf, k)
        if ranking == "diffused":
            return diffused_dot(q, self.doc_atoms, self.idf, self.n_docs, k)
        return maxsim(q, self.doc_atoms, self.affinity, self.idf, k)
