"""Learned operators against plain restatements, and what they must find wherever it stands in a text."""

import random
import re
from itertools import pairwise, product

import numpy as np
import pyarrow as pa
import pytest

from glyphmill.llm import crf, quality, rules, secrets
from glyphmill.llm.rows import table

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def texts(spark):
    return [r.text or "" for r in table(spark, SF, "documents").orderBy("doc_id").collect()]


@pytest.fixture(scope="module")
def windows(texts):
    return [w for k, t in enumerate(texts[::2]) for w in secrets.windows_of(t, k * 7919)]


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(9)
    for _ in range(30):
        chain = crf.Chain(np.zeros((1, 3)), rng.normal(0, 1, (3, 3)), rng.normal(0, 1, 3))
        lengths = np.array([4, 0, 1, 5])
        e = rng.normal(0, 1, (10, 3))
        got, at = crf.viterbi(e, chain, crf.Batch(lengths)), 0
        for n in lengths.tolist():
            best = max(product(range(3), repeat=n), key=lambda p: sum(e[at + i, s] for i, s in enumerate(p)) + (chain.first[p[0]] if p else 0) + sum(chain.moves[a, b] for a, b in pairwise(p)))
            assert got[at : at + n].tolist() == list(best)
            at += n


def plain_spans(tagger, text):
    """Token by token, with whole Viterbi."""
    places = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    x = np.array([secrets.shape_features(text[s:e]) for s, e in places]).reshape(len(places), secrets.N_SHAPE)
    none = np.zeros((1, secrets.N_SHAPE))
    whole = secrets.file_features(int(x[:, secrets.MIXED].sum()), int(x[:, secrets.OPENER].sum()), len(x))
    full = np.concatenate([x, np.concatenate([none, x[:-1]])[: len(x)], np.concatenate([x[1:], none])[: len(x)], np.tile(whole, (len(x), 1))], 1)
    state = crf.viterbi(full @ tagger.chain.weights, tagger.chain, crf.Batch(np.array([len(x)])))
    base = secrets.base_spans(text)
    covered = {i for _, s, e in base for i in range(s, e)}
    found, i = list(base), 0
    while i < len(state):
        j = i
        while state[i] and j + 1 < len(state) and state[j + 1] == 2:
            j += 1
        if state[i]:
            part: list[int] = []
            for at in [*range(places[i][0], places[j][1]), -1]:
                if at >= 0 and at not in covered:
                    part.append(at)
                    continue
                run = "".join(text[k] for k in part)
                left = len(run) - len(run.lstrip(secrets._SIDES + " \t\n\r\x0b\x0c"))
                run = run.strip(secrets._SIDES + " \t\n\r\x0b\x0c")
                if any(c.isalnum() for c in run):
                    found.append(("crf", part[left], part[left] + len(run)))
                part = []
        i = j + 1
    return secrets.joined(found)


def test_scans_against_plain_tagging(texts, windows):
    tagger = secrets.train(windows)
    maker, rng = secrets.Maker(4), random.Random(4)
    odd = ["ééééééééé", "日本語日本語", "x" * 300, "\x01a\x01", "'token'=" + "Ab3" * 9, "a" * 250 + "password=abcdefgh12345", "=", "\x1c", "deadbeef" * 4, "AKIA" + "Q" * 16]
    made = []
    for k in range(400):
        w = texts[k % len(texts)].split()[:40]
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w) + 1) : 0] = rng.choice([maker.secret()[0], maker.other(), [rng.choice(odd)]])
        made.append(rng.choice([" ", "\n", "  ", "\t"]).join(w))
    made += ["", " ", odd[0], odd[1]]
    want = [plain_spans(tagger, t) for t in made]
    assert sum("crf" in x for x in want) > 50
    for order in (range(len(made)), range(len(made) - 1, -1, -1)):
        scanner = secrets.Scanner(tagger)
        order = list(order)
        for at in range(0, len(order), 150):
            part = order[at : at + 150]
            assert [secrets.joined(x) for x in scanner.scan(pa.array([made[k] for k in part]))] == [want[k] for k in part]


@pytest.mark.parametrize("left_out", [1, 2, 6])
def test_secrets_of_kinds_not_learned(texts, windows, left_out):
    scanner = secrets.Scanner(secrets.train(windows, secrets.Maker(1, tuple(k for k in range(8) if k != left_out))))
    rng, maker = random.Random(3), secrets.Maker(9, (left_out,))
    clean = [t for t in texts[1::2] if not secrets.base_spans(t)]
    made, places = [], []
    for t in clean[:300]:
        w, v = t.split(" "), maker.value()
        i = rng.randrange(len(w) + 1)
        before = "".join(x + " " for x in w[:i])
        made.append(f"{before}{v} {' '.join(w[i:])}")
        places.append((len(before), len(before) + len(v)))
    found = [any(s <= a + 1 and e >= b - 2 for _, s, e in spans) for spans, (a, b) in zip(scanner.scan(pa.array(made)), places, strict=True)]
    assert np.mean(found) >= 0.9
    assert np.mean([bool(x) for x in scanner.scan(pa.array(clean[:300]))]) <= 0.01


def test_secrets_late_in_a_text(spark, texts):
    token = "ghp_" + "aB3dE6gH9jK2mN5pQ8sT1vW4yZ7b"
    late = ("the plain words of a long text . " * 900) + token + " and more"
    d = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(10_000, late), (10_001, late.replace(token, "nothing"))], "doc_id bigint, text string")
    rows = {r.doc_id: r for r in secrets.find(d).where("doc_id >= 10000").collect()}
    at = late.index(token)
    assert rows[10_000].spans == f"crf:{at}:{at + len(token)}" and rows[10_000].n_crf == 1 and rows[10_001].spans == ""


def test_windows_come_from_all_over_a_text():
    text = "word " * 6000 + "token = 0123456789abcdef0123456789abcdef and " + "word " * 3000
    (w,) = secrets.windows_of(text, 5)
    assert any(w.states) and len(w.tokens) <= 2 * secrets.AROUND + 1
    assert {secrets.windows_of("9 " + "word " * 9000, seed)[-1].whole[2] for seed in range(5)} == {9001}


def plain_line_features(text):
    out, seen = [], set()
    for line in re.split("(?<=\n)", text):
        words = re.findall(r"[^\x20\x09-\x0D]+", line)
        if not words:
            continue
        body = "".join(words)
        latin = sum(ord(c) >= 128 for c in body)
        upper, lower = (sum(lo <= c <= hi for c in body) for lo, hi in (("A", "Z"), ("a", "z")))
        n, chars, letters = len(words), len(body), max(1, upper + lower + latin)

        def share(of, among, most):
            return min(sum(c in among for c in body) / of, most)

        same = re.sub(r"[\x20\x09-\x0D]", " ", line).rstrip(" ")
        out.append(
            (
                [
                    min(np.log1p(n) / 5, 2), min(chars / n / 10, 3), share(n, "#*$%&|<>@^~{}[]\\", 3), upper / letters, share(chars, "0123456789", 9), share(n, ".,;:?", 3), share(n, "!", 3), share(n, "|", 2),
                    sum(a == b for a, b in pairwise(words)) / n, len(set(words)) / n, float(same in seen), latin / chars, float("A" <= line[0] <= "Z"),
                    float(any(c in "#*$%&|<>@^~{}[]\\" for c in body)),
                ],
                chars,
            )
        )
        seen.add(same)
    return out


def test_quality_against_plain_marginals():
    rng = random.Random(2)
    words = ["the", "The", "WORD", "x1", "12", "###", "a|b", "é", "été!", "ok.", "ok.", "日本", "<b>"]
    lines = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 7))) for _ in range(30)]
    made = ["\n".join(rng.choice(lines) for _ in range(rng.randrange(0, 8))) for _ in range(60)] + ["", "\n\n", "one\n", "a\na\na"]
    raw = [t.encode() for t in made]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
    x, chars, counts = quality.line_features(np.frombuffer(b"".join(raw), np.uint8), offsets)
    gen = np.random.default_rng(3)
    model = quality.Model(crf.Chain(gen.normal(0, 1, (3 * quality.N_OWN + 3, 2)), gen.normal(0, 1, (2, 2)), gen.normal(0, 1, 2)), 1.0, 0.0)
    got, at = model.good_share(x, chars, counts), 0
    for k, t in enumerate(made):
        plain = plain_line_features(t)
        n = len(plain)
        assert counts[k] == n
        own = np.array([f for f, _ in plain]).reshape(n, quality.N_OWN)
        assert np.allclose(x[at : at + n], own) and chars[at : at + n].tolist() == [c for _, c in plain]
        at += n
        none = np.zeros((1, quality.N_OWN))
        ends = np.array([[float(i > 0), float(i + 1 < n), 1.0] for i in range(n)]).reshape(n, 3)
        full = np.concatenate([own, np.concatenate([none, own])[:n], np.concatenate([own[1:], none])[:n], ends], 1)
        e = full @ model.chain.weights
        paths = {p: np.exp(sum(e[i, s] for i, s in enumerate(p)) + (model.chain.first[p[0]] if n else 0) + sum(model.chain.moves[a, b] for a, b in pairwise(p))) for p in product((0, 1), repeat=n)}
        marginal = [sum(v for p, v in paths.items() if p[i]) / sum(paths.values()) for i in range(n)]
        want = sum(m * c for m, (_, c) in zip(marginal, plain, strict=True)) / max(1, sum(c for _, c in plain))
        assert np.isclose(got[k], want)


def test_quality_of_lines_late_in_a_text(spark):
    """Bad lines lie behind the 300th only, in learning and in scoring."""
    rng = random.Random(6)

    def line(bad):
        return " ".join(rng.choice(["###", "$$$", "|", "###"] if bad else ["plain", "words", "of", "a", "text."]) for _ in range(8))

    docs, marks = [], []
    for k in range(80):
        good = k % 2 == 0
        docs.append((k, "\n".join([line(False) for _ in range(300)] + [line(not good) for _ in range(60)])))
        marks.append((k, int(good)))
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    rows = quality.score(d, spark.createDataFrame(marks, "doc_id bigint, quality int")).collect()
    assert all((r.score >= 0.5) == (r.doc_id % 2 == 0) for r in rows) and any(r.held_out for r in rows)


def test_stretches():
    assert quality.stretches(0, 1, 200) == [] and quality.stretches(200, 1, 200) == [(0, 200)]
    parts = quality.stretches(5013, 3, 200)
    assert sum(b - a for a, b in parts) <= 200 and len(parts) == 8 and len({tuple(quality.stretches(5013, s, 200)) for s in range(20)}) == 20


def test_verdict_is_the_first_rule_that_covers(spark):
    docs = rules.with_counts(table(spark, SF, "documents").select("doc_id", "text"))
    seen = sorted(map(tuple, docs.select("doc_id", *[rules.statistic(n) for n in rules.NAMES]).collect()))
    x = np.array([r[1:] for r in seen])
    high = [np.quantile(x[:, k], 0.8) for k in range(x.shape[1])]
    learned = rules.learn(x, (x[:, 4] > high[4]) | ((x[:, 7] > high[7]) & (x[:, 5] < np.median(x[:, 5]))) | (x[:, 10] > high[10]))
    assert len(learned) > 2 and max(map(len, learned)) > 1
    got = [r.v for r in docs.select("doc_id", rules.verdict(learned).alias("v")).orderBy("doc_id").collect()]
    for k, said in enumerate(got):
        first = next((n for n, rule in enumerate(learned) if rules.covers(rule, x[k : k + 1])[0]), None)
        assert (said is None) == (first is None) and (said is None or said.startswith(f"{first + 1}: "))
