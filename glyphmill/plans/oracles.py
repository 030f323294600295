"""The registered queries in DuckDB's SQL, put together from named parts. They share the fixed tables with the engine, not its plans."""

from __future__ import annotations

import re

from glyphmill.functions.lexicon import (
    CLUSTERS,
    COOCCURRENCE_STOP_WORDS,
    DOMAINS,
    FALLBACK,
    PREFIXES,
    RANGES,
    SLOT_NAMES,
    SLOT_WEIGHTS,
    STOP_WORDS,
    SUFFIXES,
    Lexicon,
    cluster_of,
)
from glyphmill.sources import synthetic

LEXICON = Lexicon()
N_CLUSTERS = 8
TURNS = "turns AS (SELECT conv_id * 1000 + turn AS doc_id, text FROM conversations)"
ITEMS = "items AS (SELECT item_id AS query_id, text AS query_text FROM benchmark)"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _values(rows: list[tuple], names: str) -> str:
    def cell(x: object) -> str:
        return "NULL" if x is None else _q(x) if isinstance(x, str) else repr(x)

    return "(VALUES " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows) + f") AS v({names})"


def _raw(text: str) -> str:
    return f"list_filter(regexp_split_to_array(lower(coalesce({text}, '')), '\\s+'), lambda x: x <> '')"


def _words(text: str) -> str:
    return f"list_transform({_raw(text)}, lambda x: trim(x, '.,!?;:\"''()'))"


def _letters(text: str) -> str:
    return f"list_filter(regexp_extract_all(lower(coalesce({text}, '')), '[\\p{{L}}\\p{{M}}\\p{{N}}_]+'), lambda x: regexp_matches(x, '^[a-z]{{2,}}$'))"


def _content(text: str, stop: list[str]) -> str:
    words = f"list_transform(list_filter({_raw(text)}, lambda x: length(x) > 2), lambda x: trim(x, '.,!?;:\"''()'))"
    return f"list_filter({words}, lambda x: x NOT IN ({', '.join(map(_q, stop))}))"


def _with(*parts: str, select: str) -> str:
    return "WITH " + ",\n".join(dict.fromkeys(parts)) + "\n" + select


# BM25, statistics ------------------------------------------------------------------------------------------------------------


def _bm25(k: int) -> list[str]:
    return [
        ITEMS,
        f"dw AS (SELECT doc_id, {_words('text')} AS ws FROM documents)",
        "dl AS (SELECT doc_id, len(ws) AS n FROM dw)",
        "whole AS (SELECT count(*) AS n_docs, avg(n) AS avg_length FROM dl)",
        "tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(ws) AS term FROM dw) GROUP BY ALL)",
        "df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)",
        f"qt AS (SELECT query_id, unnest({_words('query_text')}) AS term FROM items)",
        "scored AS (SELECT query_id, doc_id, sum(ln((n_docs - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / avg_length))) AS score "
        "FROM qt JOIN tf USING (term) JOIN df USING (term) JOIN dl USING (doc_id), whole GROUP BY query_id, doc_id)",
        f"bm25 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM scored) WHERE rank <= {k})",
    ]


def _idf(source: str) -> list[str]:
    return [
        f"dt AS (SELECT unnest(list_distinct(list_filter({_words('text')}, lambda x: length(x) > 2))) AS term FROM {source})",
        f"idf AS (SELECT term, count(*) AS df, ln((SELECT count(*) FROM {source}) / count(*)) AS idf FROM dt GROUP BY term)",
    ]


def _weights(source: str, name: str) -> list[str]:
    return [
        f"{name}_w AS (SELECT doc_id, unnest({_content('text', STOP_WORDS)}) AS term FROM {source})",
        f"{name} AS (SELECT s.doc_id, coalesce(w, 1.0) AS weight FROM {source} s LEFT JOIN (SELECT doc_id, avg(coalesce(idf, 0.0)) AS w FROM {name}_w LEFT JOIN idf USING (term) GROUP BY doc_id) USING (doc_id))",
    ]


def _domains(source: str, name: str) -> list[str]:
    votes = _values(sorted(LEXICON.votes.items()), "word, domain")
    return [
        f"{name}_p AS (SELECT doc_id, unnest({_words('text')}) AS word, generate_subscripts({_words('text')}, 1) AS pos FROM {source})",
        f"{name}_n AS (SELECT doc_id, domain, count(*) AS n, min(pos) AS at_ FROM {name}_p JOIN {votes} USING (word) GROUP BY ALL)",
        f"{name}_b AS (SELECT doc_id, domain FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, at_) AS rn FROM {name}_n) WHERE rn = 1)",
        f"{name} AS (SELECT s.doc_id, coalesce(domain, 'general') AS domain FROM {source} s LEFT JOIN {name}_b USING (doc_id))",
    ]


_MARKS = sorted(LEXICON.votes)
MARKED = (
    f"marked AS (SELECT p_partkey AS doc_id, concat_ws(' ', m[(p_partkey % {len(_MARKS)} + 1)::INT], m[((p_partkey * 7) % {len(_MARKS)} + 1)::INT], m[((p_partkey * 7) % {len(_MARKS)} + 1)::INT], p_name) AS text "
    f"FROM part, (SELECT [{', '.join(map(_q, _MARKS))}] AS m))"
)


def _cooc(source: str) -> list[str]:
    return [
        f"cw AS (SELECT doc_id, {_content('text', COOCCURRENCE_STOP_WORDS)} AS ws FROM {source})",
        "ci AS (SELECT doc_id, ws, unnest(range(0, len(ws))) AS i FROM cw)",
        "cp AS (SELECT doc_id, ws, i, unnest(range(greatest(i - 6, 0), least(i + 7, len(ws)))) AS j FROM ci)",
        "cooc AS (SELECT ws[i + 1] AS w1, ws[j + 1] AS w2, count(*) AS n, min({'d': doc_id, 'i': i, 'j': j}) AS seen FROM cp WHERE i <> j GROUP BY 1, 2)",
        "totals AS (SELECT w1 AS word, sum(n)::BIGINT AS total, min(seen) AS seen FROM cooc GROUP BY 1)",
    ]


def _clusters() -> list[str]:
    return [
        TURNS,
        *_cooc("turns"),
        "best AS (SELECT word, row_number() OVER (ORDER BY total DESC, seen, word) AS rk FROM totals WHERE length(word) > 2 QUALIFY rk <= 150)",
        f"seeds_n AS (SELECT CASE WHEN count(*) < {N_CLUSTERS} THEN greatest(2, count(*) // 3) ELSE {N_CLUSTERS} END AS k FROM best)",
        "eight AS (SELECT word, rk, list(w2) AS near FROM (SELECT b.word, b.rk, c.w2, row_number() OVER (PARTITION BY b.word ORDER BY c.seen) AS x FROM best b JOIN cooc c ON c.w1 = b.word WHERE b.rk <= 40) WHERE x <= 8 GROUP BY ALL)",
        "overlap AS (SELECT a.word, a.rk, coalesce(sum(len(list_intersect(a.near, b.near))), 0) AS o FROM eight a LEFT JOIN eight b ON b.rk <= 30 AND b.word <> a.word GROUP BY ALL)",
        "seeds AS (SELECT * FROM (SELECT word AS seed, row_number() OVER (ORDER BY o DESC, rk) - 1 AS cid FROM overlap) WHERE cid < (SELECT k FROM seeds_n))",
        "rest AS (SELECT word FROM best WHERE word NOT IN (SELECT seed FROM seeds))",
        "tie AS (SELECT word, cid, sum(n) AS n FROM (SELECT w1 AS word, w2 AS seed, n FROM cooc UNION ALL SELECT w2, w1, n FROM cooc) JOIN seeds USING (seed) JOIN rest USING (word) GROUP BY ALL)",
        "joined AS (SELECT word, cid FROM tie QUALIFY row_number() OVER (PARTITION BY word ORDER BY n DESC, cid) = 1)",
        "clusters AS (SELECT seed AS word, cid::INT AS cid FROM seeds UNION ALL SELECT word, coalesce(cid, 0)::INT FROM rest LEFT JOIN joined USING (word))",
    ]


def _tags(source: str, name: str) -> list[str]:
    return [
        f"{name}_p AS (SELECT doc_id, unnest({_words('text')}) AS word, generate_subscripts({_words('text')}, 1) AS pos FROM {source})",
        f"{name}_b AS (SELECT doc_id, cid FROM (SELECT doc_id, cid, count(*) AS n, min(pos) AS at_ FROM {name}_p JOIN clusters USING (word) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, at_) = 1)",
        f"{name} AS (SELECT s.doc_id, coalesce(cid, -1)::INT AS cid FROM {source} s LEFT JOIN {name}_b USING (doc_id))",
    ]


# Encoder ---------------------------------------------------------------------------------------------------------------------

_KNOWN = sorted(LEXICON.lookup, key=lambda t: (-len(t), t))
_WHOLE = "|".join(re.escape(t) for t in _KNOWN if t.isalpha())
_PART = "|".join(re.escape(t) for t in _KNOWN if len(t) > 1 and t.isalpha())
DICTIONARY = "dictionary AS (SELECT * FROM " + _values([(t, n, cluster_of(n) or "Low-Tier") for t, n in LEXICON.lookup.items()], "surface, id, cluster") + ")"
RANGE_TABLE = "ranges AS (SELECT * FROM " + _values([(name, lo, hi, slot, rank, k) for k, (name, lo, hi, slot, rank) in enumerate(CLUSTERS)], "cluster, lo, hi, slot, rank, ord") + ")"


def _tokens(source: str, name: str) -> list[str]:
    """The lexicon's one token with a mark inside (real-time) is cut from the text before its letters are."""
    return [
        DICTIONARY,
        f"{name}_r AS (SELECT doc_id, unnest(rs) AS run, generate_subscripts(rs, 1) AS k FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), 'real-time|\\p{{L}}+|(?s:.)') AS rs FROM {source}))",
        f"{name}_s AS (SELECT doc_id, k, CASE WHEN regexp_matches(run, '^\\p{{L}}+$') THEN regexp_extract_all(run, {_q(f'(?:{_WHOLE})$|(?:{_PART})|' + chr(92) + 'p{L}+')}) ELSE [run] END AS ps FROM {name}_r)",
        f"{name}_t AS (SELECT doc_id, k, unnest(ps) AS surface, generate_subscripts(ps, 1) AS j FROM {name}_s)",
        f"{name} AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k, j) - 1)::INT AS pos, t.surface, coalesce(d.id, CASE WHEN NOT regexp_matches(t.surface, '^\\p{{L}}') THEN unicode(t.surface) END)::INT AS id, "
        f"coalesce(cluster, CASE WHEN NOT regexp_matches(t.surface, '^\\p{{L}}') THEN 'ASCII' END) AS cluster FROM {name}_t t LEFT JOIN dictionary d ON d.surface = t.surface)",
    ]


#: DuckDB's edit distance goes by bytes: letters of several bytes are given others of one for it.
_FOLD = "translate(word, 'àâáäãåæçéèêëíìîïñóòôöõøœúùûüÿß', '0123456789!#$%&*+/<=>?@[]^_{|}~')"


def _hints(hints: dict[str, str], test: str, more: int) -> str:
    return "CASE " + " ".join(f"WHEN {test}(word, {_q(h)}) AND length(word) > {len(h) + more} THEN {_q(c)}" for h, c in sorted(hints.items(), key=lambda x: -len(x[0]))) + " END"


def _registry(tokens: str, name: str, earlier: str | None = None) -> list[str]:
    vocabulary = "vocab AS (SELECT * FROM " + _values([(k, w, cluster_of(n)) for k, (w, n) in enumerate(LEXICON.words.items())], "ord, known, cluster") + ")"
    used = _values([(c, top, RANGES[c][1]) for c, top in LEXICON.used.items()], "cluster, top, hi")
    base = f"{name}_base AS (SELECT cluster, top, hi FROM {used})" if earlier is None else f"{name}_base AS (SELECT u.cluster, greatest(u.top, coalesce(h.held, u.top)) AS top, u.hi FROM {used.replace('AS v', 'AS u')} LEFT JOIN (SELECT cluster, max(id) AS held FROM {earlier} GROUP BY 1) h ON h.cluster = u.cluster)"
    anti = "" if earlier is None else f" AND surface NOT IN (SELECT word FROM {earlier})"
    out = [
        vocabulary,
        base,
        f"{name}_u AS (SELECT surface AS word, min({{'d': doc_id, 'p': pos}}) AS seen FROM {tokens} WHERE id IS NULL{anti} GROUP BY 1)",
        f"{name}_h AS (SELECT word, seen, {_hints(PREFIXES, 'starts_with', 2)} AS l1, {_hints(SUFFIXES, 'ends_with', 1)} AS l2 FROM {name}_u)",
        f"{name}_l3 AS (SELECT word, arg_min(cluster, (d, ord)) AS l3, min(d) AS d FROM (SELECT word, cluster, ord, levenshtein({_FOLD}, known) AS d FROM {name}_h JOIN vocab ON abs(length(known) - length(word)) <= 5 WHERE l1 IS NULL AND l2 IS NULL) GROUP BY word)",
        f"{name}_ok AS (SELECT word, l3 FROM {name}_l3 WHERE d <= greatest(2, length(word) // 3) AND l3 IS NOT NULL)",
        f"{name}_g AS (SELECT word, k, i, substring(word, i, k) AS run FROM (SELECT word, k, unnest(range(1, length(word) - k + 2)) AS i FROM {name}_h, (VALUES (3), (4)) AS n(k) WHERE l1 IS NULL AND l2 IS NULL AND word NOT IN (SELECT word FROM {name}_ok)))",
        f"{name}_l4 AS (SELECT word, cluster AS l4 FROM (SELECT word, cluster, sum(CASE k WHEN 3 THEN 4 ELSE 3 END) AS votes, min({{'k': k, 'i': i, 'o': ord}}) AS at_ FROM {name}_g JOIN vocab ON contains(known, run) WHERE cluster IS NOT NULL AND cluster <> {_q(FALLBACK)} GROUP BY ALL) "
        "QUALIFY row_number() OVER (PARTITION BY word ORDER BY votes DESC, at_) = 1 AND votes >= 6)",
        f"{name}_m AS (SELECT word, seen, coalesce(l1, l2, l3, l4, {_q(FALLBACK)}) AS cluster, CASE WHEN l1 IS NOT NULL THEN 'prefix' WHEN l2 IS NOT NULL THEN 'suffix' WHEN l3 IS NOT NULL THEN 'edit_distance' WHEN l4 IS NOT NULL THEN 'ngram_voting' ELSE 'fallback' END AS method "
        f"FROM {name}_h LEFT JOIN {name}_ok USING (word) LEFT JOIN {name}_l4 USING (word))",
        f"{name}_f AS (SELECT word, seen, m.cluster, method, top + row_number() OVER (PARTITION BY m.cluster ORDER BY seen, word) AS id, hi FROM {name}_m m JOIN {name}_base USING (cluster))",
        f"{name}_fits AS (SELECT word, id, cluster, method FROM {name}_f WHERE cluster <> {_q(FALLBACK)} AND id <= hi)",
        f"{name}_o AS (SELECT word, seen, CASE WHEN cluster = {_q(FALLBACK)} THEN method ELSE 'fallback_cluster_full' END AS method FROM {name}_m WHERE word NOT IN (SELECT word FROM {name}_fits))",
        f"{name}_late AS (SELECT word, CASE WHEN top + rn <= hi THEN top + rn END AS id, {_q(FALLBACK)} AS cluster, method FROM (SELECT *, row_number() OVER (ORDER BY seen, word) AS rn FROM {name}_o), (SELECT top, hi FROM {name}_base WHERE cluster = {_q(FALLBACK)}))",
    ]
    whole = f"SELECT word, id, cluster, method FROM {name}_fits UNION ALL SELECT word, id, cluster, method FROM {name}_late"
    return [*out, f"{name} AS ({whole}" + (f" UNION ALL SELECT word, id, cluster, method FROM {earlier})" if earlier else ")")]


def _synthetic(n: int, seed: int) -> str:
    """Templates and fills chosen by digests of id, field and seed."""

    def chosen(of: list[str], *by: object) -> str:
        told = ", ".join(["id::VARCHAR", *(_q(str(x)) for x in by)])
        return f"[{', '.join(map(_q, of))}][(('0x' || substring(md5(concat_ws(':', {told})), 1, 8))::BIGINT % {len(of)}) + 1]"

    cases = []
    for name, (templates, fills) in synthetic.DOMAINS.items():
        text = chosen(templates, seed, name)
        for key, values in fills.items():
            text = f"replace({text}, {_q('{' + key + '}')}, {chosen(values, seed, name, key)})"
        cases.append(f"WHEN {_q(name)} THEN {text}")
    return f"SELECT id AS doc_id, CASE domain {' '.join(cases)} END AS text, domain FROM (SELECT id, {chosen(list(synthetic.DOMAINS), seed, 'domain')} AS domain FROM range({n}) AS r(id))"


def _trace(tokens: str, registry: str, name: str) -> list[str]:
    return [f"{name} AS (SELECT doc_id, pos, surface, id, cluster FROM {tokens} WHERE cluster IS NOT NULL UNION ALL SELECT doc_id, pos, surface, r.id, r.cluster FROM {tokens} t JOIN {registry} r ON r.word = t.surface WHERE t.cluster IS NULL)"]


def _blueprint(trace: str, name: str) -> list[str]:
    return [
        RANGE_TABLE,
        f"{name} AS (SELECT doc_id, slot::INT AS slot, id::INT AS value FROM {trace} JOIN ranges USING (cluster) WHERE slot IS NOT NULL AND id IS NOT NULL AND length(trim(surface)) >= 4 QUALIFY row_number() OVER (PARTITION BY doc_id, slot ORDER BY rank DESC, pos) = 1)",
    ]


ENCODED = [
    TURNS,
    ITEMS,
    "asked AS (SELECT query_id AS doc_id, query_text AS text FROM items)",
    *_tokens("turns", "tt"),
    *_tokens("asked", "qt"),
    *_registry("tt", "reg"),
    *_registry("qt", "reg2", "reg"),
    *_trace("tt", "reg", "ttr"),
    *_trace("qt", "reg2", "qtr"),
    *_blueprint("ttr", "bp"),
    *_blueprint("qtr", "qbp"),
    "sig AS (SELECT doc_id, bit_or(1 << slot)::INT AS signature, count(*)::INT AS n_slots FROM bp GROUP BY 1)",
    "qsig AS (SELECT doc_id AS query_id, bit_or(1 << slot)::INT AS q_signature, count(*)::INT AS n_slots FROM qbp GROUP BY 1)",
    "shared AS (SELECT q.doc_id AS query_id, d.doc_id, count(*) AS n_shared, sum(abs(q.value - d.value)) AS gap FROM qbp q JOIN bp d USING (slot) GROUP BY 1, 2)",
    "zone AS (SELECT DISTINCT q.doc_id AS query_id, d.doc_id FROM qbp q JOIN bp d ON d.slot = q.slot AND d.value BETWEEN q.value - 150 AND q.value + 150)",
    "linear AS (SELECT query_id, doc_id, gap / n_shared AS distance FROM shared WHERE n_shared >= 2 AND gap / n_shared <= 150)",
    "matrix AS (SELECT query_id, doc_id, round(distance, 2) AS distance FROM linear SEMI JOIN zone USING (query_id, doc_id))",
]
BUCKET = "(SELECT ord FROM ranges WHERE value BETWEEN lo AND hi)"
BUCKETS = [
    *ENCODED,
    f"db AS (SELECT doc_id, slot, {BUCKET} AS b FROM bp)",
    f"qb AS (SELECT doc_id AS query_id, slot, {BUCKET} AS b FROM qbp)",
    "cand AS (SELECT DISTINCT query_id, doc_id FROM qb JOIN db ON db.slot = qb.slot AND abs(db.b - qb.b) <= 1)",
    "bdist AS (SELECT query_id, doc_id, CASE WHEN u = 0 THEN 0.0 ELSE round((g + 200.0 * (u - s)) / u, 4) END AS distance FROM (SELECT i.query_id, t.doc_id, bit_count(coalesce(q_signature, 0) | coalesce(signature, 0)) AS u, coalesce(gap, 0) AS g, coalesce(n_shared, 0) AS s FROM items i CROSS JOIN turns t LEFT JOIN qsig ON qsig.query_id = i.query_id LEFT JOIN sig ON sig.doc_id = t.doc_id LEFT JOIN shared ON shared.query_id = i.query_id AND shared.doc_id = t.doc_id))",
]
_LABELS = "CASE WHEN distance <= {} THEN 'Nearly identical' WHEN distance <= {} THEN 'Very similar' WHEN distance <= {} THEN 'Related topic' WHEN distance <= {} THEN 'Different topic' ELSE 'Completely unrelated' END"
LEARNED = [
    *ENCODED,
    *_idf("turns"),
    *_weights("turns", "dwt"),
    *_weights("asked", "qwt"),
    *_domains("turns", "dom"),
    *_domains("asked", "qdom"),
    *_clusters(),
    *_tags("turns", "tag"),
    *_tags("asked", "qtag"),
    "slotw AS (SELECT * FROM " + _values([(d, k, w) for d, ws in SLOT_WEIGHTS.items() for k, w in enumerate(ws)], "domain, slot, w") + ")",
    "wpairs AS (SELECT q.doc_id AS query_id, d.doc_id, sum(abs(q.value - d.value) * coalesce(w, 1.0)) / sum(coalesce(w, 1.0)) AS near, count(*) AS n_shared FROM qbp q JOIN bp d USING (slot) JOIN dom ON dom.doc_id = d.doc_id JOIN qdom ON qdom.doc_id = q.doc_id "
    "LEFT JOIN slotw ON slotw.domain = dom.domain AND dom.domain = qdom.domain AND dom.domain <> 'general' AND slotw.slot = q.slot GROUP BY 1, 2)",
    "wdist AS (SELECT query_id, doc_id, round(near / (2 * wa * wb / (wa + wb)) + 30.0 * bit_count(xor(q_signature, signature)) / bit_count(q_signature | signature), 4) AS distance, n_shared FROM (SELECT p.*, greatest(0.5, least(qw.weight, 5.0)) AS wa, greatest(0.5, least(dw2.weight, 5.0)) AS wb FROM wpairs p JOIN qwt qw ON qw.doc_id = p.query_id JOIN dwt dw2 ON dw2.doc_id = p.doc_id) JOIN sig USING (doc_id) JOIN qsig USING (query_id))",
    "pool AS (SELECT q.doc_id AS query_id, d.doc_id, CASE WHEN d.cid = -1 THEN 1 ELSE 0 END AS pool FROM qtag q JOIN tag d ON d.cid = q.cid OR d.cid = -1)",
]


def _zoned(pool: str, name: str) -> list[str]:
    return [
        f"{name}_s AS (SELECT s.*, p.pool, z.doc_id IS NOT NULL AS inside FROM shared s JOIN {pool} p USING (query_id, doc_id) LEFT JOIN zone z ON z.query_id = s.query_id AND z.doc_id = s.doc_id)",
        f"{name} AS (SELECT * FROM (SELECT *, bool_or(inside) OVER (PARTITION BY query_id) AS some_ FROM {name}_s) WHERE inside OR NOT some_)",
    ]


def _nearest(source: str, distance: str, k: int, name: str) -> list[str]:
    return [
        f"{name}_d AS (SELECT query_id, doc_id, pool, {distance} AS distance FROM {source})",
        f"{name} AS (SELECT query_id, rank, doc_id, distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, pool, doc_id) AS rank FROM {name}_d) WHERE rank <= {k})",
    ]


_TWO = "round(CAST(distance AS DECIMAL(18, 4)), 2)::DOUBLE"


def _weighted_search(pool: str, k: int, name: str) -> list[str]:
    return [*_zoned(pool, f"{name}_z"), f"{name}_j AS (SELECT query_id, doc_id, pool, w.distance FROM {name}_z JOIN wdist w USING (query_id, doc_id) WHERE w.distance <= 100)", *_nearest(f"{name}_j", _TWO, k, name)]


CONCEPTS = [
    *_clusters(),
    f"concepts AS (SELECT DISTINCT doc_id, cid FROM (SELECT doc_id, unnest(list_transform(list_filter({_raw('text')}, lambda x: length(x) > 2), lambda x: trim(x, '.,!?;:\"''()'))) AS word FROM turns) JOIN clusters USING (word))",
    "edges AS (SELECT src, dst, n, n / sum(n) OVER (PARTITION BY src) AS w FROM (SELECT a.cid AS src, b.cid AS dst, count(*) AS n FROM concepts a JOIN concepts b ON a.doc_id = b.doc_id AND a.cid <> b.cid GROUP BY 1, 2))",
    "freq AS (SELECT cid, count(*) AS df, ln((t + 1.0) / (count(*) + 1.0)) + 1 AS idf, CASE WHEN count(*) / t < 0.05 THEN 1.0 WHEN count(*) / t > 0.5 THEN 0.1 ELSE 1.0 - (count(*) / t - 0.05) / 0.45 * 0.9 END AS genericity FROM concepts, (SELECT count(*) AS t FROM turns) GROUP BY cid, t)",
]


def _diffused(start: str, edges: str, name: str, hops: int = 3, damping: float = 0.7, dangling: bool = True) -> list[str]:
    out, now = [], start
    for k in range(hops):
        kept = f"energy * {(1 - damping) * 0.5!r}"
        if dangling:
            kept = f"CASE WHEN cid IN (SELECT src FROM {edges}) THEN {kept} ELSE energy * {damping} END"
        to = name if k == hops - 1 else f"{name}_{k}"
        out.append(f"{to} AS (SELECT query_id, cid, sum(energy) AS energy FROM (SELECT query_id, dst AS cid, energy * w * {damping} AS energy FROM {now} JOIN {edges} ON src = cid UNION ALL SELECT query_id, cid, {kept} FROM {now}) GROUP BY ALL)")
        now = to
    return out


def _ranked(energy: str, concepts: str, k: int, name: str) -> list[str]:
    return [
        f"{name}_s AS (SELECT query_id, doc_id, round(sum(energy), 3) AS score FROM {concepts} JOIN {energy} USING (cid) GROUP BY 1, 2)",
        f"{name} AS (SELECT query_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM {name}_s WHERE score > 0) WHERE rank <= {k})",
    ]


ROW_ENERGY = [
    *ENCODED,
    *CONCEPTS,
    "rowc AS (SELECT DISTINCT doc_id, value AS cid FROM bp)",
    "e0 AS (SELECT doc_id AS query_id, value AS cid, sum(CASE WHEN value > 7 THEN 2.0 ELSE 1.0 END) AS energy FROM qbp GROUP BY ALL)",
]
QRELS = [ITEMS, "qrels AS (SELECT query_id, doc_id, CASE WHEN toxic > 0 THEN 2 ELSE quality END AS rel FROM items, labels)"]


def _metrics(gain: str) -> list[str]:
    return [
        *_bm25(100),
        *QRELS,
        "pos AS (SELECT query_id, count(*) AS n_relevant FROM qrels WHERE rel > 0 GROUP BY 1)",
        f"ideal AS (SELECT query_id, sum({gain} / log2(rank + 1)) AS idcg FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC) AS rank FROM qrels) WHERE rank <= 10 GROUP BY 1)",
        "j AS (SELECT b.query_id, b.rank, coalesce(rel, 0) AS rel FROM bm25 b LEFT JOIN qrels USING (query_id, doc_id))",
        "jh AS (SELECT *, sum(CASE WHEN rel > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY rank) AS hits FROM j)",
        f"r AS (SELECT query_id, sum(CASE WHEN rank <= 10 THEN {gain} / log2(rank + 1) ELSE 0 END) AS dcg, sum(CASE WHEN rel > 0 THEN hits / rank ELSE 0 END) AS aps, min(rank) FILTER (rel > 0) AS first, avg(CASE WHEN rel > 0 THEN 1.0 ELSE 0 END) FILTER (rank <= 10) AS precision, count(*) FILTER (rel > 0 AND rank <= 100) AS found FROM jh GROUP BY 1)",
        "m AS (SELECT query_id, coalesce(dcg / nullif(idcg, 0), 0) AS ndcg, coalesce(aps / n_relevant, 0) AS ap, coalesce(1.0 / first, 0) AS rr, coalesce(precision, 0) AS precision, coalesce(found / n_relevant, 0) AS recall FROM pos LEFT JOIN ideal USING (query_id) LEFT JOIN r USING (query_id))",
    ]


def _truth(least: int, source: str) -> list[str]:
    return [
        ITEMS,
        f"truth AS (SELECT DISTINCT query_id, doc_id FROM (SELECT doc_id, unnest({_raw('text')}) AS word FROM {source}) JOIN (SELECT query_id, unnest(list_filter({_raw('query_text')}, lambda x: length(x) >= {least})) AS word FROM items) USING (word))",
    ]


ATOMS = [
    "atoms AS (SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY value DESC, atom) AS rnk, atom, value FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS value, generate_subscripts(embedding, 1) - 1 AS atom FROM embeddings) WHERE value > 0 QUALIFY rnk <= 8)",
    "aidf AS (SELECT atom, ln(((SELECT count(*) FROM embeddings) + 1.0) / (count(*) + 1.0)) + 1 AS idf FROM atoms GROUP BY 1)",
    "qa AS (SELECT vec_id AS query_id, atom, value FROM atoms WHERE vec_id % 100 = 0)",
]


def _top(scored: str) -> str:
    return f"SELECT query_id, rank, doc_id, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM {scored} WHERE score > 0) WHERE rank <= 10"


_ROUNDED = ", ".join(f"round({c}, 5) AS {c}" for c in ("ndcg", "ap", "rr", "precision", "recall"))
_CENTROIDS = [
    *_clusters(),
    f"lw AS (SELECT doc_id, pos, word FROM (SELECT doc_id, unnest({_words('text')}) AS word, generate_subscripts({_words('text')}, 1) AS pos FROM turns) WHERE length(word) > 2)",
    "home AS (SELECT doc_id, cid FROM (SELECT doc_id, cid, count(*) AS n, min(pos) AS at_ FROM lw JOIN clusters USING (word) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, at_) = 1)",
    "cent AS (SELECT cid, word FROM (SELECT cid, word, count(*) AS n FROM lw JOIN home USING (doc_id) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY cid ORDER BY n DESC, word) <= 20)",
    "dset AS (SELECT DISTINCT doc_id, word FROM lw)",
    "sim AS (SELECT doc_id, cid, count(*) / (any_value(ds.n) + any_value(cs.n) - count(*)) AS sim FROM dset JOIN cent USING (word) JOIN (SELECT doc_id, count(*) AS n FROM dset GROUP BY 1) ds USING (doc_id) JOIN (SELECT cid, count(*) AS n FROM cent GROUP BY 1) cs USING (cid) GROUP BY doc_id, cid)",
    "near AS (SELECT * FROM sim QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(sim, 12) DESC, cid) <= 3)",
]
RELATIONS = [
    *_clusters(),
    *_tags("turns", "tag"),
    f"bw AS (SELECT cid, word FROM (SELECT cid, word, count(*) AS n FROM (SELECT doc_id, unnest({_words('text')}) AS word FROM turns) JOIN tag USING (doc_id) WHERE length(word) > 2 GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY cid ORDER BY n DESC, word) <= 30)",
    "bsz AS (SELECT cid, count(*) AS n FROM bw GROUP BY 1)",
    "bsim AS (SELECT x.cid AS a, y.cid AS b, count(*) / (any_value(sx.n) + any_value(sy.n) - count(*)) AS sim FROM bw x JOIN bw y ON x.word = y.word AND x.cid <> y.cid JOIN bsz sx ON sx.cid = x.cid JOIN bsz sy ON sy.cid = y.cid GROUP BY 1, 2)",
    "bnear AS (SELECT a, b, sim FROM bsim QUALIFY row_number() OVER (PARTITION BY a ORDER BY round(sim, 12) DESC, b DESC) <= 3)",
    "relations AS (SELECT a AS bucket, b AS related FROM bnear WHERE sim >= 0.03 UNION SELECT b, a FROM bnear WHERE sim >= 0.03)",
]
FIVE = [
    *LEARNED,
    "f5 AS (SELECT q.doc_id AS query_id, d.doc_id, count(*) AS n, sum(exp(-(abs(q.value - d.value) ** 2) / 225.0) * coalesce(w, 1.0)) / count(*) AS alignment, sum(abs(q.value - d.value)) AS gap, exp(-arg_min(abs(q.value - d.value), (q.value, q.slot)) / 10.0) AS activation, "
    "least(sum(CASE WHEN abs(q.value - d.value) > 100 THEN abs(q.value - d.value) / 200.0 * coalesce(w, 1.0) ELSE 0.0 END) / count(*), 1.0) AS conflict FROM qbp q JOIN bp d USING (slot) JOIN dom ON dom.doc_id = d.doc_id JOIN qdom ON qdom.doc_id = q.doc_id "
    "LEFT JOIN slotw ON slotw.domain = dom.domain AND dom.domain = qdom.domain AND dom.domain <> 'general' AND slotw.slot = q.slot GROUP BY 1, 2)",
    f"rare AS (SELECT query_id, doc_id, least(sum(idf) / 10.0, 1.0) AS rare FROM (SELECT query_id, unnest(list_distinct({_raw('query_text')})) AS term FROM items) JOIN idf USING (term) JOIN (SELECT doc_id, unnest(list_distinct({_raw('text')})) AS term FROM turns) USING (term) GROUP BY 1, 2)",
    "five AS (SELECT query_id, doc_id, round(alignment * 2.0 + coalesce(rare, 0.0) * 1.5 + greatest(0.0, least(n / bit_count(q_signature | signature) * (1.0 - gap / (n * 200.0)), 1.0)) + activation * 0.5 - conflict, 3) AS score FROM f5 LEFT JOIN rare USING (query_id, doc_id) JOIN sig USING (doc_id) JOIN qsig USING (query_id))",
]

ORACLES: dict[str, str] = {
    "bm25_topk": _with(*_bm25(10), select="SELECT query_id, rank, doc_id, round(score, 4) AS score FROM bm25"),
    "bm25_stats": _with(*_bm25(10)[:4], select="SELECT n_docs, round(avg_length, 6) AS avg_length FROM whole"),
    "idf": _with(*_idf("documents"), select="SELECT term, df, round(idf, 6) AS idf FROM idf"),
    "sentence_weight": _with(*_idf("documents"), *_weights("documents", "wt"), select="SELECT doc_id, round(weight, 5) AS weight FROM wt"),
    "query_weights": _with(
        ITEMS, *_idf("documents"), f"t AS (SELECT query_id, unnest(list_distinct({_words('query_text')})) AS term FROM items)",
        select=f"SELECT query_id, term, round(coalesce(idf, 0.0), 6) AS weight FROM t LEFT JOIN idf USING (term) WHERE length(term) > 2 AND term NOT IN ({', '.join(map(_q, STOP_WORDS))})",
    ),
    "domain_hint": _with(MARKED, *_domains("marked", "dom"), select="SELECT doc_id, domain FROM dom"),
    "cooccurrence": _with(TURNS, *_cooc("turns"), select="SELECT w1, w2, n FROM cooc"),
    "word_totals": _with(*_cooc("documents"), select="SELECT word, total FROM totals"),
    "word_clusters": _with(*_clusters(), select="SELECT word, cid FROM clusters"),
    "cluster_labels": _with(*_clusters(), select="SELECT cid, string_agg(word, ' ' ORDER BY rk) AS labels FROM (SELECT cid, word, row_number() OVER (PARTITION BY cid ORDER BY coalesce(total, 0) DESC, word DESC) AS rk FROM clusters LEFT JOIN totals USING (word)) WHERE rk <= 5 GROUP BY cid"),
    "tags": _with(*_clusters(), *_tags("turns", "tag"), select="SELECT doc_id, cid FROM tag"),
    "bucket_sizes": _with(*_clusters(), *_tags("turns", "tag"), select="SELECT cid, count(*) AS n FROM tag GROUP BY cid"),
    "vocabulary_report": _with(RANGE_TABLE, "words AS (SELECT * FROM " + _values(list(LEXICON.words.items()), "word, id") + ")", select="SELECT cluster, count(word) AS n_words, any_value(hi - lo + 1) AS capacity FROM ranges LEFT JOIN words ON id BETWEEN lo AND hi GROUP BY cluster"),
    "encode_tokens": _with(TURNS, *_tokens("turns", "tok"), select="SELECT doc_id, pos, surface, id, cluster FROM tok"),
    "encode_counts": _with(*_tokens("documents", "tok"), select="SELECT doc_id, count(*) AS n_tokens, count(*) FILTER (cluster IS NULL) AS n_unknown, sum(id)::BIGINT AS id_sum FROM tok GROUP BY doc_id"),
    "registry": _with(ITEMS, "asked AS (SELECT query_id AS doc_id, query_text AS text FROM items)", *_tokens("asked", "qt"), *_registry("qt", "reg"), select="SELECT word, id::INT AS id, cluster, method FROM reg"),
    "blueprint": _with(*ENCODED, select="SELECT doc_id, slot, value FROM bp"),
    "slot_names": _with(*ENCODED, "names AS (SELECT * FROM " + _values(list(enumerate(SLOT_NAMES)), "k, name") + ")", select="SELECT doc_id, name AS slot, value FROM bp JOIN names ON names.k = bp.slot"),
    "shared_slots": _with(*ENCODED, select="SELECT query_id, doc_id, bit_count(q_signature & signature)::INT AS n FROM zone JOIN qsig USING (query_id) JOIN sig USING (doc_id)"),
    "decode_roundtrip": _with(
        ITEMS, "qd AS (SELECT query_id AS doc_id, query_text AS text FROM items)", *_tokens("qd", "qtok"), *_registry("qtok", "reg"), *_trace("qtok", "reg", "tr"),
        "rev AS (SELECT * FROM " + _values(list(LEXICON.reverse.items()), "id, token") + ")", "named AS (SELECT id, max(word) AS word FROM reg WHERE id IS NOT NULL GROUP BY 1)",
        "said AS (SELECT doc_id, pos, CASE WHEN pos IS NULL THEN '' ELSE coalesce(word, token, CASE WHEN id BETWEEN 32 AND 126 THEN chr(id::INT) END, '<UNK:' || coalesce(id::VARCHAR, 'None') || '>') END AS part "
        "FROM qd LEFT JOIN tr USING (doc_id) LEFT JOIN named USING (id) LEFT JOIN rev USING (id))",
        select="SELECT doc_id, string_agg(part, '' ORDER BY pos) AS text FROM said GROUP BY 1",
    ),
    "synthetic_corpus": _synthetic(1000, 42),
    "signature": _with(*ENCODED, select="SELECT doc_id, coalesce(signature, 0)::INT AS signature, coalesce(n_slots, 0)::INT AS n_slots FROM turns LEFT JOIN sig USING (doc_id)"),
    "semantic_group": _with(
        *ENCODED,
        "sg AS (SELECT doc_id, r.cluster, r.lo, r.hi, count(*) AS n, min(pos) AS at_ FROM ttr t JOIN ranges r ON t.id BETWEEN r.lo AND r.hi WHERE r.cluster <> 'Miscellaneous' GROUP BY ALL)",
        "sb AS (SELECT * FROM sg QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, at_) = 1)",
        select="SELECT t.doc_id, coalesce(replace(replace(lower(cluster), ' ', '_'), '&', 'and'), 'miscellaneous') AS sem_group, coalesce(lo || '-' || hi, '4901-9999') AS sem_score FROM (SELECT DISTINCT doc_id FROM ttr) t LEFT JOIN sb USING (doc_id)",
    ),
    "semantic_distance": _with(
        ITEMS, "asked AS (SELECT query_id AS doc_id, query_text AS text FROM items)", *_tokens("asked", "qt"),
        "ids AS (SELECT doc_id, list(id ORDER BY pos) AS ids FROM qt WHERE id IS NOT NULL GROUP BY 1)",
        "pairs AS (SELECT a.doc_id AS query_id, b.doc_id, a.ids AS x, b.ids AS y, greatest(len(a.ids), len(b.ids)) AS n FROM ids a, ids b)",
        "gaps AS (SELECT query_id, doc_id, round(sum(abs(coalesce(x[i], 32) - coalesce(y[i], 32))) / any_value(n), 4) AS distance FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM pairs) GROUP BY 1, 2)",
        select="SELECT query_id, doc_id, round(CAST(distance AS DECIMAL(18, 4)), 3)::DOUBLE AS distance, " + _LABELS.format(5, 20, 100, 500) + " AS label FROM gaps",
    ),
    "blueprint_distance": _with(*BUCKETS, select="SELECT query_id, doc_id, round(CAST(distance AS DECIMAL(18, 4)), 3)::DOUBLE AS distance, " + _LABELS.format(10, 50, 150, 350) + " AS label FROM bdist SEMI JOIN cand USING (query_id, doc_id) WHERE distance <= 150"),
    "blueprint_scan": _with(*BUCKETS, select="SELECT query_id, doc_id, round(CAST(distance AS DECIMAL(18, 4)), 3)::DOUBLE AS distance, " + _LABELS.format(10, 50, 150, 350) + " AS label FROM bdist WHERE distance <= 150"),
    "slot_filter": _with(*ENCODED, select="SELECT doc_id FROM bp WHERE slot = 1 AND value BETWEEN 4391 AND 4410"),
    "range_query": _with(*ENCODED, select="SELECT DISTINCT doc_id FROM ttr WHERE id BETWEEN 3751 AND 3800"),
    "zone_candidates": _with(*ENCODED, select="SELECT query_id, doc_id FROM zone"),
    "matrix_linear": _with(*ENCODED, select="SELECT query_id, doc_id, round(distance, 4) AS distance FROM linear"),
    "matrix_search": _with(*ENCODED, select="SELECT query_id, doc_id, distance FROM matrix"),
    "weighted_linear": _with(*LEARNED, select=f"SELECT query_id, doc_id, {_TWO} AS distance FROM wdist WHERE distance <= 100"),
    "clustered_search": _with(
        *LEARNED, *_zoned("pool", "z"), "zd AS (SELECT query_id, doc_id, pool, gap / n_shared AS distance FROM z WHERE n_shared >= 2 AND gap / n_shared <= 100)", *_nearest("zd", "round(distance, 2)", 20, "top"), select="SELECT query_id, rank, doc_id, distance FROM top"
    ),
    "store_search": _with(*LEARNED, *_weighted_search("pool", 10, "top"), select="SELECT query_id, rank, doc_id, distance FROM top"),
    "excluded_search": _with(
        *LEARNED, *_weighted_search("pool", 5, "page1"), "pool2 AS (SELECT * FROM pool ANTI JOIN page1 USING (query_id, doc_id))", *_weighted_search("pool2", 5, "page2"), select="SELECT query_id, rank, doc_id, distance FROM page2"
    ),
    "search_statistics": _with(
        *LEARNED, *_zoned("pool", "z"),
        select="SELECT q.doc_id AS query_id, q.cid AS query_cluster, (SELECT count(*) FROM turns) AS total, (SELECT count(*) FROM pool p WHERE p.query_id = q.doc_id) AS cluster_size, (SELECT count(*) FROM z_s p WHERE p.query_id = q.doc_id) AS signature_pass, "
        "(SELECT count(*) FROM z p WHERE p.query_id = q.doc_id) AS zone_candidates, (SELECT count(*) FROM z p JOIN wdist w USING (query_id, doc_id) WHERE p.query_id = q.doc_id AND w.distance <= 100) AS within FROM qtag q",
    ),
    "bucket_relations": _with(*RELATIONS, select="SELECT bucket, related FROM relations"),
    "related_search": _with(
        *LEARNED, *RELATIONS,
        "rpool AS (SELECT query_id, doc_id, min(pool) AS pool FROM (SELECT * FROM pool UNION ALL SELECT q.doc_id, d.doc_id, 2 FROM qtag q JOIN relations ON bucket = q.cid JOIN tag d ON d.cid = related) GROUP BY 1, 2)",
        *_weighted_search("rpool", 20, "top"), select="SELECT query_id, rank, doc_id, distance FROM top",
    ),
    "memberships": _with(*_CENTROIDS, select="SELECT doc_id, cid, round(sim / sum(sim) OVER (PARTITION BY doc_id), 6) AS weight FROM near UNION ALL SELECT doc_id, -1, 0.05 FROM turns"),
    "five_part_search": _with(*FIVE, select="SELECT query_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM five) WHERE rank <= 10"),
    "concept_graph": _with(*CONCEPTS, select="SELECT src, dst, n, round(w, 6) AS w FROM edges"),
    "concept_weights": _with(*CONCEPTS, select="SELECT cid, df, round(idf, 6) AS idf, round(genericity, 6) AS genericity FROM freq"),
    "diffuse_energy": _with(
        ITEMS, *CONCEPTS, "e0 AS (SELECT query_id, cid, count(*)::DOUBLE AS energy FROM (SELECT query_id, unnest(" + _letters("query_text") + ") AS word FROM items) JOIN clusters USING (word) GROUP BY ALL)",
        *_diffused("e0", "edges", "e"), select="SELECT query_id, cid, round(energy, 6) AS energy FROM e",
    ),
    "energy_search": _with(*ROW_ENERGY, *_diffused("e0", "edges", "e"), *_ranked("e", "rowc", 10, "top"), select="SELECT query_id, rank, doc_id, score FROM top"),
    "pruned_energy_search": _with(
        *ROW_ENERGY, *_diffused("e0", "edges", "e"), "em AS (SELECT query_id, cid, energy FROM e QUALIFY energy >= avg(energy) OVER (PARTITION BY query_id) - 1e-9)", *_ranked("em", "rowc", 10, "top"), select="SELECT query_id, rank, doc_id, score FROM top"
    ),
    "directed_search": _with(
        *ROW_ENERGY, "ed0 AS (SELECT doc_id AS query_id, value AS cid, sum(coalesce(idf, 1.0)) AS energy FROM qbp LEFT JOIN freq ON freq.cid = value GROUP BY ALL)", *_diffused("ed0", "edges", "ed"),
        "edw AS (SELECT query_id, cid, energy * coalesce(idf, 1.0) * coalesce(genericity, 1.0) AS energy FROM ed LEFT JOIN freq USING (cid))", *_ranked("edw", "rowc", 10, "top"), select="SELECT query_id, rank, doc_id, score FROM top",
    ),
    "direct_energy": _with(
        ITEMS, *_clusters(), f"concepts AS (SELECT DISTINCT doc_id, cid FROM (SELECT doc_id, unnest({_letters('text')}) AS word FROM turns) JOIN clusters USING (word))", CONCEPTS[-2],
        f"e0 AS (SELECT query_id, cid, count(*)::DOUBLE AS energy FROM (SELECT query_id, unnest({_letters('query_text')}) AS word FROM items) JOIN clusters USING (word) GROUP BY ALL)",
        *_diffused("e0", "edges", "e"), *_ranked("e", "concepts", 20, "top"), select="SELECT query_id, rank, doc_id, score FROM top",
    ),
    "metrics": _with(*_metrics("rel"), select=f"SELECT query_id, {_ROUNDED} FROM m"),
    "metrics_macro": _with(*_metrics("rel"), select="SELECT count(*) AS n_queries, " + ", ".join(f"round(avg({c}), 5) AS {c}" for c in ("ndcg", "ap", "rr", "precision", "recall")) + " FROM m"),
    "binary_ndcg": _with(*_metrics("(CASE WHEN rel > 0 THEN 1 ELSE 0 END)"), select="SELECT query_id, round(ndcg, 5) AS ndcg FROM m"),
    "keyword_relevance": _with(*_truth(9, "documents"), select="SELECT query_id, doc_id FROM truth"),
    "set_metrics": _with(
        *_bm25(10), *_truth(9, "documents"), "x AS (SELECT coalesce(b.query_id, t.query_id) AS query_id, b.doc_id AS f, t.doc_id AS t FROM bm25 b FULL JOIN truth t ON b.query_id = t.query_id AND b.doc_id = t.doc_id)",
        "n AS (SELECT query_id, count(*) FILTER (f IS NOT NULL AND t IS NOT NULL) AS tp, count(*) FILTER (t IS NULL) AS fp, count(*) FILTER (f IS NULL) AS fn FROM x GROUP BY 1)",
        "pr AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall FROM n)",
        select="SELECT query_id, tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 6) AS f1 FROM pr",
    ),
    "threshold_sweep": _with(
        *ENCODED, *_truth(5, "turns"), "alld AS (SELECT s.query_id, s.doc_id, CASE WHEN n_shared >= 2 THEN gap / n_shared ELSE 9999.0 END AS distance, t.doc_id IS NOT NULL AS rel FROM shared s LEFT JOIN truth t ON t.query_id = s.query_id AND t.doc_id = s.doc_id)",
        select="SELECT threshold::DOUBLE AS threshold, count(*) FILTER (distance <= threshold) AS returned, count(*) FILTER (distance <= threshold AND rel) AS relevant FROM (VALUES (50), (100), (200), (300), (500), (800), (1500), (3000), (9000)) AS t(threshold), alld GROUP BY threshold",
    ),
    "index_agreement": _with(
        *ENCODED, select="SELECT count(*) FILTER (m.doc_id IS NOT NULL AND l.doc_id IS NOT NULL) AS both, count(*) FILTER (l.doc_id IS NULL) AS only_found, count(*) FILTER (m.doc_id IS NULL) AS only_reference FROM matrix m FULL JOIN linear l ON m.query_id = l.query_id AND m.doc_id = l.doc_id"
    ),
    "explain_ranks": _with(*_bm25(100), *QRELS, select="SELECT query_id, doc_id, rel, rank FROM qrels LEFT JOIN bm25 USING (query_id, doc_id) WHERE rel > 0"),
    "tfidf": _with(
        "tc AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')) AS term FROM documents) GROUP BY ALL)",
        "v AS (SELECT term, ln((n + 1) / (count(*) + 1)) + 1 AS idf FROM tc, (SELECT count(*) AS n FROM documents) GROUP BY term, n HAVING count(*) >= 2 AND count(*) <= 0.95 * n ORDER BY sum(tf) DESC, term LIMIT 2000)",
        "x AS (SELECT doc_id, term, (ln(tf) + 1) * idf AS x FROM tc JOIN v USING (term))", select="SELECT doc_id, term, round(x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)), 5) AS w FROM x",
    ),
    "top_atoms": _with(*ATOMS, select="SELECT vec_id, rnk, atom::INT AS atom, round(value, 6) AS value FROM atoms"),
    "atom_idf": _with(*ATOMS, select="SELECT atom::INT AS atom, round(idf, 6) AS idf FROM aidf"),
    "maxsim": _with(
        *ATOMS, "b AS (SELECT query_id, d.vec_id AS doc_id, q.atom AS a, q.value * idf AS weight, max(d.value / (1.0 + abs(q.atom - d.atom))) AS best FROM qa q JOIN aidf USING (atom), atoms d GROUP BY ALL)", "s AS (SELECT query_id, doc_id, sum(weight * best) AS score FROM b GROUP BY 1, 2)", select=_top("s")
    ),
    "gated_dot": _with(
        *ATOMS, "g AS (SELECT * FROM qa QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY value DESC, atom) <= 5)", "dm AS (SELECT vec_id AS doc_id, atom, value - sum(value) OVER (PARTITION BY vec_id) / 64 AS value FROM atoms)",
        "s AS (SELECT query_id, doc_id, sum(g.value * idf * dm.value) AS score FROM g JOIN aidf USING (atom) JOIN dm USING (atom) WHERE dm.value > 0 GROUP BY 1, 2)", select=_top("s"),
    ),
    "diffused_dot": _with(
        *ATOMS, "ae AS (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS w FROM (SELECT a.atom AS src, b.atom AS dst, count(*) AS n FROM atoms a JOIN atoms b ON a.vec_id = b.vec_id AND a.atom <> b.atom GROUP BY 1, 2))",
        "sh AS (SELECT atom, count(*) / (SELECT count(*) FROM embeddings) AS share FROM atoms GROUP BY 1)", "e0 AS (SELECT query_id, atom AS cid, value * idf AS energy FROM qa JOIN aidf USING (atom))", *_diffused("e0", "ae", "e", 2, 0.6, False),
        "qd AS (SELECT query_id, cid AS atom, energy * CASE WHEN share < 0.05 THEN 1.0 WHEN share > 0.5 THEN 0.1 ELSE 1.0 - (share - 0.05) / 0.45 * 0.9 END * idf AS weight FROM e JOIN sh ON sh.atom = cid JOIN aidf ON aidf.atom = cid)",
        "s AS (SELECT query_id, vec_id AS doc_id, sum(weight * value) AS score FROM qd JOIN atoms USING (atom) GROUP BY 1, 2)", select=_top("s"),
    ),
    "ndjson_roundtrip": _with(
        TURNS, *_tokens("turns", "tok"), "n AS (SELECT doc_id, count(*)::INT AS len FROM tok GROUP BY 1)", select="SELECT row_number() OVER (ORDER BY doc_id) AS id, coalesce(len, 0) AS len, substring(md5(coalesce(text, '')), 1, 8) AS hash FROM turns LEFT JOIN n USING (doc_id)"
    ),
}
assert set(DOMAINS) <= set(SLOT_WEIGHTS)
