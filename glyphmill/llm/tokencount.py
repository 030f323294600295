"""Token counts of a unigram tokenizer without its tokens: Viterbi that carries the best score and the number of pieces.

An Aho-Corasick automaton lists the vocabulary pieces that end at each character, longest first. The best path to a character is taken
over them; of paths of equal score the one whose last piece is longest wins, and the unknown piece of one character, open only where
the vocabulary has no piece of that character alone, comes last. These are the rules of tokenizers.models.Unigram.

Where no piece reaches over a border, the text's best path is the chunks' best paths in a row. Borders are in front of a space mark and
around characters that no longer piece holds; both are checked against the vocabulary, and scores must be whole numbers, so that
sums are exact in any order. Otherwise whole texts are one chunk. A task remembers chunks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from glyphmill.llm.rows import buffers_of, map_batches, pick, slices, texts_of

MARK = "▁"
UNKNOWN_PENALTY = 10.0
REMEMBERED = 400_000


@dataclass(frozen=True)
class Vocabulary:
    """Pieces with their scores. With byte_fallback an unknown character counts as its UTF-8 bytes, else a run of them as one piece."""

    pieces: tuple[tuple[str, float], ...]
    byte_fallback: bool = True
    dummy_prefix: bool = True


def from_sentencepiece(path: str) -> Vocabulary:
    """The pieces and scores of a sentencepiece model, taken as a unigram vocabulary."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return Vocabulary(tuple((model.id_to_piece(k), model.get_score(k)) for k in range(model.get_piece_size())))


class Counter:
    def __init__(self, vocabulary: Vocabulary):
        import ahocorasick

        self.vocabulary = vocabulary
        self.automaton = ahocorasick.Automaton()
        scores = dict(vocabulary.pieces)  # a repeated piece has its last score, as in the tokenizer's own table
        for piece, score in scores.items():
            if piece:
                self.automaton.add_word(piece, (len(piece), float(score)))
        self.empty = not scores
        if not self.empty:
            self.automaton.make_automaton()
        self.unknown = min((s for _, s in vocabulary.pieces), default=0.0) - UNKNOWN_PENALTY
        self.single = {p for p in scores if len(p) == 1}
        self.known: dict[str, tuple[int, float]] = {}
        whole = all(float(s).is_integer() for s in scores.values())
        crossing = any(re.search(f"[^{MARK}]{MARK}", p) for p in scores)
        # runs of unknown characters count as one piece without byte_fallback, and may reach over a border
        self.chunk = None
        if whole and not crossing and vocabulary.byte_fallback:
            inside = set("".join(p for p in scores if len(p) > 1))
            alone = "".join(re.escape(c) for c in "\n\t\r" if c not in inside)
            self.chunk = re.compile(f"[{alone}]|{MARK}+[^{MARK}{alone}]*|[^{MARK}{alone}]+" if alone else f"{MARK}+[^{MARK}]*|[^{MARK}]+")

    def best(self, text: str) -> tuple[int, float]:
        """Number of pieces and score of the best path."""
        n = len(text)
        scores, counts = [0.0] + [None] * n, [0] * (n + 1)
        runs = [False] * (n + 1)  # whether the best path to here ends in an unknown character
        fallback, single, unknown = self.vocabulary.byte_fallback, self.single, self.unknown
        at = 0

        def close(upto: int) -> None:
            """Unknown pieces for the characters before `upto` that no match has ended at."""
            nonlocal at
            while at < upto:
                c = text[at]
                if c not in single:
                    s = scores[at] + unknown
                    if scores[at + 1] is None or s > scores[at + 1]:
                        scores[at + 1] = s
                        counts[at + 1] = counts[at] + (len(c.encode("utf-8", "surrogatepass")) if fallback else not runs[at])
                        runs[at + 1] = True
                at += 1

        if not self.empty:
            for end, (length, score) in self.automaton.iter(text):
                if end > at:
                    close(end)
                s = scores[end + 1 - length] + score
                if scores[end + 1] is None or s > scores[end + 1]:
                    scores[end + 1] = s
                    counts[end + 1] = counts[end + 1 - length] + 1
                    runs[end + 1] = False
        close(n)
        return counts[n], scores[n]

    def count(self, text: str) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        text = text.replace(" ", MARK)
        if self.vocabulary.dummy_prefix:
            text = MARK + text
        if self.chunk is None:
            return self.best(text)
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        pieces, total = 0, 0.0
        for chunk in self.chunk.findall(text):
            got = known.get(chunk)
            if got is None:
                got = known[chunk] = self.best(chunk)
            pieces += got[0]
            total += got[1]
        return pieces, total


@lru_cache(1)
def _counter(vocabulary: Vocabulary) -> Counter:
    return Counter(vocabulary)


def count_tokens(docs: DataFrame, vocabulary: Vocabulary, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, score, n_chars), a row for each input row: pieces of the whole text, without special tokens.

    Null and empty texts have 0 tokens. Repeated rows and null ids stay as they are.
    """
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)
    df = pick(docs, doc_id, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(held.value)
        for b in batches:
            offsets, _ = buffers_of(b.column(1))
            for i, j in slices(offsets):
                texts = texts_of(b.column(1).slice(i, j - i))
                got = [counter.count(t) for t in texts]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.float64()), pa.array(map(len, texts), pa.int64())], ["doc_id", "n_tokens", "score", "n_chars"])

    return map_batches(df, run, f"doc_id {df.schema[doc_id].dataType.simpleString()}, n_tokens bigint, score double, n_chars bigint")
