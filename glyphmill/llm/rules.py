"""Quality rules: decision lists learned by sequential covering, emitted as ordered Spark conditions.

Text statistics are counted once a document. From the statistics of labelled documents, rules of the form "statistic <= or >=
threshold and ..." are grown condition by condition on two thirds of the rows by information gain, pruned on the other third, and
kept while they hold on that third; rows a rule covers leave before the next is grown. The ordered rules become one CASE WHEN.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphmill.llm.rows import held_out, map_batches, parts_of, pick, positional, raw_of

#: At most so many labelled documents are learned from, those with the smallest hash of their id.
MAX_LABELLED = 6000
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_punct", "n_distinct", "n_short"]

_UPPER, _DIGITS, _SYMBOLS, _PUNCT = bytes(range(65, 91)), bytes(range(48, 58)), b"#*$%&|<>", b".,;:!?"
_SPACE, _TAILS = b" \t\n\x0b\x0c\r", bytes(range(128, 192))


def repeated_words(words: list[bytes], window: int = 3) -> tuple[int, int]:
    """Words that lie in a window found twice or more, and distinct words."""
    uniq = set(words)
    n = len(words) - window + 1
    if n < 2:
        return 0, len(uniq)
    of = dict(zip(uniq, range(len(uniq)), strict=True))
    ids = np.fromiter(map(of.__getitem__, words), np.int64, len(words))
    key, top = ids[:n], len(uniq)
    for k in range(1, window):
        if top * len(uniq) >= 1 << 62:
            key = np.unique(key, return_inverse=True)[1]
            top = len(key)
        key = key * len(uniq) + ids[k : k + n]
        top *= len(uniq)
    order = np.argsort(key)
    equal = key[order[1:]] == key[order[:-1]]
    if not equal.any():
        return 0, len(uniq)
    twice = np.zeros(n, bool)
    twice[order[1:][equal]] = True
    twice[order[:-1][equal]] = True
    cover = np.zeros(len(words), bool)
    for k in range(window):
        cover[k : k + n] |= twice
    return int(cover.sum()), len(uniq)


def counts_of(raw: bytes) -> tuple[int, ...]:
    """The COUNTS of a text."""
    words = raw.split()
    core = raw.translate(None, _SPACE)
    seen: set[bytes] = set()
    dup = lines = 0
    for line in raw.split(b"\n"):
        if line.strip():
            lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    repeat, distinct = repeated_words(words)
    less = lambda drop: len(core) - len(core.translate(None, drop))
    return len(words), len(core) - less(_TAILS), less(_SYMBOLS), dup, repeat, lines, less(_UPPER), less(_DIGITS), less(_PUNCT), distinct, sum(map((4).__gt__, map(len, words)))


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with the COUNTS before their own columns. Null texts have no words, lines or characters."""
    at, names = docs.columns.index(text), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts_of(batches, at):
            table = np.array([counts_of(x) for x in raw_of(b.column(at))], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([pa.array(table[:, k]) for k in range(len(COUNTS))] + b.columns, names=[f"_{c}" for c in COUNTS] + names)

    return map_batches(docs, run, T.StructType([*(T.StructField(f"_{c}", T.LongType()) for c in COUNTS), *docs.schema.fields]))


#: What rules may speak of, each a ratio of two counts, or a count itself.
RATIOS = {
    "symbols_per_word": ("n_symbols", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "upper_share": ("n_upper", "word_chars"),
    "digit_share": ("n_digits", "word_chars"),
    "punct_per_word": ("n_punct", "n_words"),
    "distinct_share": ("n_distinct", "n_words"),
    "short_share": ("n_short", "n_words"),
    "mean_word_chars": ("word_chars", "n_words"),
    "words_per_line": ("n_words", "n_lines"),
}
NAMES = [*RATIOS, "n_words"]


def base_failed(prefix: str = "_") -> Column:
    n, repeat = F.col(f"{prefix}n_words"), F.col(f"{prefix}n_repeat_words")
    return (n < 50) | (100 * repeat > 50 * n)


def statistic(name: str, prefix: str = "_") -> Column:
    if name not in RATIOS:
        return F.col(prefix + name).cast("double")
    over, under = (F.col(prefix + c).cast("double") for c in RATIOS[name])
    return over / F.greatest(under, F.lit(1.0))


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    threshold: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        column = x[:, NAMES.index(self.name)]
        return column >= self.threshold if self.above else column <= self.threshold

    def column(self) -> Column:
        s = statistic(self.name)
        return s >= self.threshold if self.above else s <= self.threshold

    def __str__(self) -> str:
        return f"{self.name} {'>=' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def covers(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _best_condition(x: np.ndarray, bad: np.ndarray) -> Condition | None:
    """The condition of the largest gain in information (Quinlan's FOIL measure) over the rows still covered."""
    p0, n0 = int(bad.sum()), int((~bad).sum())
    best, gain = None, 1e-9
    if not p0 or not n0:
        return None
    prior = np.log2(p0 / (p0 + n0))
    for k, name in enumerate(NAMES):
        order = np.argsort(x[:, k], kind="stable")
        v, b = x[order, k], bad[order]
        cut = np.nonzero(v[1:] > v[:-1])[0]
        if not len(cut):
            continue
        p, n = np.cumsum(b)[cut], np.cumsum(~b)[cut]
        for above in (False, True):
            ps, ns = (p0 - p, n0 - n) if above else (p, n)
            with np.errstate(divide="ignore", invalid="ignore"):
                g = np.where(ps > 0, ps * (np.log2(ps / (ps + ns)) - prior), -1.0)
            at = int(np.argmax(g))
            if g[at] > gain:
                best, gain = Condition(name, above, float((v[cut[at]] + v[cut[at] + 1]) / 2)), float(g[at])
    return best


def learn(x: np.ndarray, bad: np.ndarray, max_rules: int = 24, max_conditions: int = 4, min_precision: float = 0.95, min_covered: int = 4) -> list[Rule]:
    """The decision list for rows x (a column for each of NAMES) of which some are bad; the same for the same rows in any order given."""
    fold = np.arange(len(x)) % 3
    rules: list[Rule] = []
    left = np.ones(len(x), bool)
    while len(rules) < max_rules:
        grow, prune = left & (fold < 2), left & (fold == 2)
        if (bad & grow).sum() < min_covered:
            break
        rule: Rule = ()
        at = grow.copy()
        while len(rule) < max_conditions and (more := _best_condition(x[at], bad[at])) is not None:
            rule += (more,)
            at &= more.holds(x)
        if not rule:
            break

        def worth(r: Rule) -> tuple[float, int]:
            got = covers(r, x) & prune
            p, n = int((got & bad).sum()), int((got & ~bad).sum())
            return (p - n) / (p + n) if p + n else -1.0, -len(r)

        rule = max((rule[:k] for k in range(1, len(rule) + 1)), key=worth)
        got = covers(rule, x) & left
        p, n = int((got & bad).sum()), int((got & ~bad).sum())
        q, m = int((got & bad & prune).sum()), int((got & ~bad & prune).sum())
        if p + n == 0 or p < min_covered or p / (p + n) < min_precision or (q + m and q / (q + m) < min_precision):
            break
        rules.append(rule)
        left &= ~got
    return rules


def learn_from(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", max_labelled: int = MAX_LABELLED) -> list[Rule]:
    """Rules from at most max_labelled labelled documents outside the held-out fold; none if there are none of either label."""
    chosen = pick(labels, doc_id, label).where(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(doc_id))
    chosen = chosen.groupBy(doc_id).agg(F.min(label).alias("_label")).orderBy(F.xxhash64(doc_id), doc_id).limit(max_labelled)
    rows = with_counts(pick(docs, doc_id, text).join(F.broadcast(chosen), doc_id), text)
    stats = rows.where(~base_failed()).groupBy(doc_id).agg(F.min("_label").alias("_label"), *[F.min(statistic(n)).alias(n) for n in NAMES])
    table = sorted(map(tuple, stats.select("_label", F.xxhash64(doc_id), *NAMES).collect()), key=lambda r: r[1])
    if not table:
        return []
    data = np.array([r[2:] for r in table], np.float64)
    return learn(data, np.array([r[0] == 0 for r in table]))


def verdict(rules: list[Rule]) -> Column:
    """The first rule that holds, as text; null if none does."""
    out = None
    for k, rule in enumerate(rules):
        condition = rule[0].column()
        for c in rule[1:]:
            condition = condition & c.column()
        said = F.lit(f"{k + 1}: " + " and ".join(map(str, rule)))
        out = F.when(condition, said) if out is None else out.when(condition, said)
    return F.lit(None).cast("string") if out is None else out


def judge(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", max_labelled: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rule), a row for each input row.

    Null, empty and wordless texts have zero counts and fail the base rule. Without usable labels the base rule alone decides.
    Repeated rows stay; a doc_id that is labelled twice counts as bad if either label is.
    """
    rules = learn_from(docs, labels, doc_id, text, max_labelled=max_labelled)
    df = with_counts(pick(docs, doc_id, text), text)
    rule = F.when(base_failed(), F.lit("base")).otherwise(verdict(rules))
    return df.select(F.col(doc_id).alias("doc_id"), *[F.col(f"_{c}").alias(c) for c in COUNTS[:5]], base_failed().alias("base_failed"), rule.isNull().alias("kept"), rule.alias("rule"))


def keep_good(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", max_labelled: int = MAX_LABELLED) -> DataFrame:
    """The documents that neither the base rule nor the learned list rejects, with all their columns, whatever their names.

    Null, empty and wordless texts go: the base rule rejects them. Texts are judged whole, however long. Repeated rows stay or go
    together, as do rows of any id, null too; without usable labels the base rule alone decides, and an empty table stays empty.
    """
    rules = learn_from(docs, labels, doc_id, text, max_labelled=max_labelled)
    plain, (place,) = positional(docs, text)
    return with_counts(plain, place).where(~base_failed() & verdict(rules).isNull()).select(*plain.columns).toDF(*docs.columns)
