"""SQL that gives the rows of those queries which SQL can express on whole tables."""

from __future__ import annotations

from weftline.llm.quality_rules import BASE, POLICIES, RULES

_BLANK = r"[\x20\x09-\x0D]+"
_LOW = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{_BLANK}'), lambda x: x <> '')"


_bits = " + ".join(f"CASE WHEN {fails} THEN {1 << i} ELSE 0 END" for i, (_, fails) in enumerate(RULES))

QUALITY_RULES = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
d AS (SELECT doc_id, t, {words("t")} AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
win AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS x FROM d, unnest(range(1, len(w) - 1)) u(i)),
rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, x) > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM rep, unnest([i, i + 1, i + 2]) u(p) GROUP BY doc_id),
m AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
      (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines, (length(t) - length(translate(t, '!', '')))::BIGINT AS n_exclaims
      FROM d LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, ({_bits})::BIGINT AS fail_bits FROM m)
SELECT *, fail_bits & {BASE} <> 0 AS base_failed, fail_bits & {BASE | POLICIES["v1"]} = 0 AS kept FROM b"""

#: Pairs that share one of their rarest shingles, so many that similar sets must; then their full sets; then what is reachable.
NEAR_DEDUP = f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, {words(_LOW.format("text"))} AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS g FROM d),
e AS MATERIALIZED (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
f AS MATERIALIZED (SELECT doc_id, n, x, row_number() OVER (PARTITION BY doc_id ORDER BY df, x) AS k FROM e JOIN (SELECT x, count(*) AS df FROM e GROUP BY x) USING (x)),
c AS MATERIALIZED (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM f a JOIN f b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
      WHERE a.k <= a.n - (80 * a.n + 99) // 100 + 1 AND b.k <= b.n - (80 * b.n + 99) // 100 + 1),
l AS MATERIALIZED (SELECT a, b FROM (SELECT c.a, c.b, len(p.g) + len(q.g) AS n, len(list_intersect(p.g, q.g)) AS i FROM c JOIN s p ON p.doc_id = c.a JOIN s q ON q.doc_id = c.b) WHERE 100 * i >= 80 * (n - i)),
u AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(x, y) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.x, u.b FROM r JOIN u ON u.a = r.y)
SELECT doc_id, len(g)::BIGINT AS n_shingles, m AS component_id, m = doc_id AS kept FROM s JOIN (SELECT x, min(y) AS m FROM r GROUP BY x) ON x = doc_id"""

SOURCE_MIXING = rf"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][k % 3 + 1]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS cap FROM s),
h AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS held, sum(weight) OVER (ORDER BY cap / weight, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open, (SELECT sum(source_size)::DOUBLE FROM s) * 1.5::DOUBLE AS total FROM w),
t AS (SELECT source, source_size, least(cap, weight * max((total - held) / open) OVER ()) AS target FROM h),
r AS (SELECT d.doc_id, d.source, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS ratio, (('0x' || substr(md5('mix-1:' || d.doc_id), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0::DOUBLE AS u FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (SELECT *, floor(ratio) AS certain, ratio - floor(ratio) AS p FROM r),
o AS (SELECT *, target - certain * source_size AS left_over, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS rank FROM p),
c AS (SELECT *, p > 0 AND (size = 0 OR sum(size) OVER (PARTITION BY source ORDER BY CASE WHEN size > 0 THEN 0 ELSE 1 END, rank, doc_id, size ROWS UNBOUNDED PRECEDING) <= left_over) AS drawn FROM o),
g AS (SELECT source, max(left_over) - sum(CASE WHEN drawn THEN size ELSE 0 END) AS gap FROM c GROUP BY source),
n AS (SELECT c.source, arg_min(doc_id, {{'o': abs(gap - size), 'r': rank, 'd': doc_id}}) AS close_id FROM c JOIN g ON c.source IS NOT DISTINCT FROM g.source WHERE NOT drawn AND p > 0 AND size > 0 AND abs(gap - size) < gap GROUP BY c.source)
SELECT doc_id, size, source_size, target, ((certain + CASE WHEN drawn OR doc_id = close_id THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM c LEFT JOIN n ON c.source IS NOT DISTINCT FROM n.source"""

SUBSTRING_DEDUP = f"""
WITH d AS MATERIALIZED (SELECT doc_id, {words("coalesce(text, '')")} AS w FROM documents),
v AS (SELECT doc_id, s, row_number() OVER (PARTITION BY md5(array_to_string(w[s:s + 19], ' ')) ORDER BY doc_id, s) AS k FROM d, unnest(range(1, len(w) - 18)) u(s)),
g AS (SELECT DISTINCT doc_id, p FROM v, unnest(range(s, s + 20)) u(p) WHERE k > 1),
a AS (SELECT doc_id, list(p) AS gone FROM g GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
 sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END, ' ')) AS kept_sha256 FROM d LEFT JOIN a USING (doc_id)"""

_ITEM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

DECONTAMINATION = f"""
WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all({_LOW.format("text")}, '{_ITEM}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOW.format("text")}, '{_ITEM}') AS w FROM benchmark),
q AS MATERIALIZED (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS x FROM b, unnest(range(1, len(w) - least(10, len(w)) + 2)) u(i) WHERE len(w) > 0),
v AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS x FROM d, (SELECT DISTINCT n FROM q) k, unnest(range(1, len(w) - n + 2)) u(i)),
h AS MATERIALIZED (SELECT doc_id, i, v.n, item_id FROM v JOIN q ON v.n = q.n AND v.x = q.x),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM h, unnest(range(i, i + n)) u(p) GROUP BY doc_id),
s AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, sha256(array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',')) AS items FROM h GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, coalesce(items, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN s USING (doc_id)"""

_FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
_WHOLE = "list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)::BIGINT)"


def _apart(x: str, y: str) -> str:
    return f"list_sum(list_transform(list_zip({x}, {y}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"


def _floored(total: str, n: str) -> str:
    """Whole-number division of a sum by a count, downwards."""
    return f"(({total} - (({total} % {n}) + {n}) % {n}) // {n})::BIGINT"


def _codes(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
m{r} AS MATERIALIZED (SELECT vec_id, label, p, x, arg_min(e, {{'d': d, 'e': e}}) AS e, min(d) AS d FROM (SELECT vec_id, label, p, x, e, {_apart('x', 'y')} AS d FROM q JOIN b{r} USING (p)) GROUP BY vec_id, label, p, x)""")
        if r < rounds:
            mean = _floored("sum(x[i])", "count(*)")
            steps.append(f"""
s{r} AS (SELECT p, e, list(v ORDER BY i) AS y FROM (SELECT p, e, i, {mean} AS v FROM m{r}, unnest(range(1, len(x) + 1)) u(i) GROUP BY p, e, i) GROUP BY p, e),
b{r + 1} AS MATERIALIZED (SELECT p, e, coalesce(s{r}.y, b{r}.y) AS y FROM b{r} LEFT JOIN s{r} USING (p, e))""")
    return f"""
WITH k AS (SELECT vec_id, label, {_WHOLE} AS v FROM embeddings WHERE {_FINITE}),
q AS MATERIALIZED (SELECT vec_id, label, p, v[p * len(v) // {parts} + 1:(p + 1) * len(v) // {parts}] AS x FROM k, unnest(range({parts})) u(p)),
b0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS y FROM q QUALIFY e < {entries}),{",".join(steps)},
f AS (SELECT vec_id, label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM m{rounds} GROUP BY vec_id, label),
h AS (SELECT sha256(string_agg(y[i]::VARCHAR, ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM b{rounds}, unnest(range(1, len(y) + 1)) u(i))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM f, h"""


VECTOR_CODES = _codes()

WARC = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
q AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha256(b) AS payload_digest FROM p),
r AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM q)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN payload_bytes >= 100 AND first_id <> page_id THEN first_id END AS refers_to FROM r"""


def _centroids(dim: int = 64, clusters: int = 8, rounds: int = 10) -> str:
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
m{r} AS MATERIALIZED (SELECT vec_id, x, arg_min(c, {{'d': d, 'c': c}}) AS c, min(d) AS d FROM (SELECT vec_id, x, c, {_apart('x', 'y')} AS d FROM k, b{r}) GROUP BY vec_id, x)""")
        if r < rounds:
            mean = _floored("sum(x[i])", "count(*)")
            steps.append(f"""
s{r} AS (SELECT c, list(v ORDER BY i) AS y FROM (SELECT c, i, {mean} AS v FROM m{r}, unnest(range(1, {dim + 1})) u(i) GROUP BY c, i) GROUP BY c),
b{r + 1} AS MATERIALIZED (SELECT c, coalesce(s{r}.y, b{r}.y) AS y FROM b{r} LEFT JOIN s{r} USING (c))""")
    return f"""
WITH k AS MATERIALIZED (SELECT vec_id, {_WHOLE} AS x FROM embeddings WHERE {_FINITE} AND len(embedding) = {dim}),
b0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c, x AS y FROM k QUALIFY c < {clusters}),{",".join(steps)}
SELECT vec_id, c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
 sha256(array_to_string(list_transform(y, lambda v: v::VARCHAR), ',')) AS centroid_sha256 FROM m{rounds} JOIN b{rounds} USING (c)"""


CENTROIDS = _centroids()
