"""SQL twins, for DuckDB, of the operators that SQL can express."""

from __future__ import annotations

from atollkit.llm.rules import BULLET, ELLIPSIS, STOP_WORDS, THRESHOLDS, WINDOW

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def substring_dedup(n: int = 35) -> str:
    return rf"""WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
win AS (SELECT doc_id, i, w[i:i + {n - 1}] AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - {n - 2})) AS i FROM d) x),
hit AS (SELECT doc_id, i FROM win SEMI JOIN (SELECT k FROM win GROUP BY k HAVING count(*) > 1) r USING (k)),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM (SELECT doc_id, i, unnest(range(0, {n})) AS j FROM hit) x),
pos AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM pos ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""


def warc() -> str:
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    five = " || ".join(f"substr('{letters}', CAST((CAST('0x' || substr(h, {1 + 5 * i}, 5) AS BIGINT) >> {s}) & 31 AS INT) + 1, 1)" for i in range(8) for s in (15, 10, 5, 0))
    return f"""WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS f FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, {five} AS payload_digest, CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id != f THEN f END AS refers_to FROM f"""


def suffix_dedup(n: int = 50) -> str:
    return f"""WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (SELECT doc_id, i, substr(h, 2 * i + 1, {2 * n}) AS k FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - {n - 1})) AS i FROM d) x),
hit AS (SELECT doc_id, i FROM win JOIN (SELECT k, min(doc_id) AS m FROM win GROUP BY k HAVING min(doc_id) < max(doc_id)) r USING (k) WHERE doc_id > m),
gap AS (SELECT doc_id, i, lag(i) OVER w AS prev, lead(i) OVER w AS next FROM hit WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
sums AS (SELECT doc_id, sum(least({n}, coalesce(next - i, {n}))) AS removed, count(*) FILTER (prev IS NULL OR i - prev > {n}) AS spans FROM gap GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM (SELECT doc_id, i, unnest(range(0, {n})) AS j FROM hit) x),
pos AS (SELECT doc_id, p, substr(h, 2 * p + 1, 2) AS b FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2)) AS p FROM d) x),
kept AS (SELECT doc_id, string_agg(b, '' ORDER BY p) AS t FROM pos ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(t, ''))) AS kept_sha256
FROM d LEFT JOIN sums USING (doc_id) LEFT JOIN kept USING (doc_id)"""


def top_k(k: int = 10, scale: int = 1024, every: int = 100) -> str:
    return f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({scale} * CAST(x AS DOUBLE))) AS e FROM embeddings
WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id != c.vec_id WHERE q.vec_id % {every} = 0)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) x WHERE rank <= {k}"""


def quality_rules() -> str:
    measures = {
        "mean_word_chars": "word_chars / greatest(n_words, 1)",
        "symbols_per_word": "n_symbols / greatest(n_words, 1)",
        "upper_word_ratio": "n_upper / greatest(n_words, 1)",
        "stop_word_ratio": "n_stop / greatest(n_words, 1)",
        "dup_line_ratio": "n_dup_lines / greatest(n_lines, 1)",
        "mean_line_chars": "n_chars / greatest(n_lines, 1)",
        "letterless_word_ratio": "n_letterless / greatest(n_words, 1)",
        "ellipsis_line_ratio": "n_ellipsis / greatest(n_lines, 1)",
        "bullet_line_ratio": "n_bullet / greatest(n_lines, 1)",
    }
    failed = " OR ".join(f"(n_words >= {least} AND {measures[m]} {sign} {limit})" for _, m, sign, limit, least in THRESHOLDS)
    stop = ", ".join(f"'{w}'" for w in sorted({x for v in STOP_WORDS.values() for x in v}))
    n = WINDOW
    return rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
win AS (SELECT doc_id, i, w[i:i + {n - 1}] AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - {n - 2})) AS i FROM d) x),
hit AS (SELECT doc_id, i FROM win SEMI JOIN (SELECT doc_id, k FROM win GROUP BY doc_id, k HAVING count(*) > 1) r USING (doc_id, k)),
rep AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM (SELECT doc_id, i, unnest(range(0, {n})) AS j FROM hit) x GROUP BY doc_id),
m AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
len(list_filter(w, lambda x: regexp_full_match(x, '\p{{Lu}}{{2,}}\p{{P}}*'))) AS n_upper, len(list_filter(w, lambda x: x IN ({stop}))) AS n_stop,
length(text) AS n_chars, len(list_filter(w, lambda x: NOT regexp_matches(x, '\p{{L}}'))) AS n_letterless, len(list_filter(l, lambda x: regexp_matches(x, '{ELLIPSIS}'))) AS n_ellipsis, len(list_filter(l, lambda x: regexp_matches(x, '{BULLET}'))) AS n_bullet FROM d LEFT JOIN rep USING (doc_id)),
v AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({failed}) AS kept FROM v"""


def jaccard(n: int = 5, percent: int = 80) -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    low = WORDS.replace("coalesce(text, '')", f"translate(coalesce(text, ''), '{upper}', '{lower}')")
    return f"""WITH RECURSIVE d AS (SELECT doc_id, {low} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, k FROM (SELECT doc_id, w[i:i + {n - 1}] AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - {n - 2})) AS i FROM d) x UNION ALL SELECT doc_id, w FROM d WHERE len(w) BETWEEN 1 AND {n - 1}) y),
size AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_ FROM s a JOIN s b ON a.k = b.k AND a.doc_id != b.doc_id GROUP BY a.doc_id, b.doc_id),
link AS (SELECT a, b FROM pair JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * both_ >= {percent} * (x.n + y.n - both_)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, c.component_id FROM d LEFT JOIN size USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) c USING (doc_id)"""


def hard_negatives(scale: int = 256, anchors: int = 50, positives: int = 5, negatives: int = 3) -> str:
    return f"""WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor({scale} * CAST(x AS DOUBLE))) AS e FROM embeddings
WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_inner_product(a.e, c.e) AS BIGINT) AS score FROM v a JOIN v c ON a.vec_id != c.vec_id WHERE a.vec_id % {anchors} = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS n FROM s WHERE same) x WHERE n <= {positives}),
n AS (SELECT p.anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {negatives}"""


def merkle() -> str:
    def leaf(n_chars: str) -> str:
        texts = [f"CAST({c} AS VARCHAR)" for c in ("doc_id", "source", "lang", n_chars, "text")]
        said = " || ".join(f"coalesce(CAST(strlen({t}) AS VARCHAR) || ':' || {t}, '-')" for t in texts)
        return f"sha256({said})"

    byte = "list_reduce(list_prepend(xor(c, b), CAST(range(8) AS BIGINT[])), lambda a, z: xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END))"
    crc = f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: CAST(ascii(substr(CAST(doc_id AS VARCHAR), CAST(i AS INT), 1)) AS BIGINT))), lambda c, b: {byte}))"
    return f"""WITH RECURSIVE d AS (SELECT doc_id, lang, {leaf("n_chars")} AS leaf, CASE WHEN {crc} % 7 = 0 THEN {leaf("n_chars + 1")} ELSE {leaf("n_chars")} END AS present FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM d),
t AS (SELECT 0 AS k, lang, pos AS i, n, leaf AS h FROM l UNION ALL SELECT k + 1, lang, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM t WHERE n > 1 GROUP BY k, lang, i // 2, n),
s AS (SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (SELECT 0 AS k, i, n, h FROM s UNION ALL SELECT k + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM u WHERE n > 1 GROUP BY k, i // 2, n),
f AS (SELECT 0 AS k, l.lang, l.pos, l.pos AS i, n, present AS h, '' AS proof FROM l UNION ALL
SELECT f.k + 1, f.lang, f.pos, f.i // 2, (f.n + 1) // 2, sha256(CASE WHEN f.i % 2 = 1 THEN t.h || f.h ELSE f.h || coalesce(t.h, '') END), f.proof || coalesce(t.h, '')
FROM f LEFT JOIN t ON t.k = f.k AND t.lang IS NOT DISTINCT FROM f.lang AND t.i = xor(f.i, 1) WHERE f.n > 1),
g AS (SELECT 0 AS k, f.lang, f.pos, s.i, s.n, f.h, f.proof FROM f JOIN s ON s.lang IS NOT DISTINCT FROM f.lang WHERE f.n = 1 UNION ALL
SELECT g.k + 1, g.lang, g.pos, g.i // 2, (g.n + 1) // 2, sha256(CASE WHEN g.i % 2 = 1 THEN u.h || g.h ELSE g.h || coalesce(u.h, '') END), g.proof || coalesce(u.h, '')
FROM g LEFT JOIN u ON u.k = g.k AND u.i = xor(g.i, 1) WHERE g.n > 1)
SELECT l.doc_id, l.leaf, s.h AS subroot, r.h AS root, sha256(g.proof) AS proof_sha256, g.h AS folded_root, g.h = r.h AS verified
FROM l JOIN g ON g.n = 1 AND g.pos = l.pos AND g.lang IS NOT DISTINCT FROM l.lang JOIN s ON s.lang IS NOT DISTINCT FROM l.lang CROSS JOIN (SELECT h FROM u WHERE n = 1) r"""
