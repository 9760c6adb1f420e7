"""DuckDB statements for the queries that SQL can express, with every pattern and constant written out.

Only the license texts beyond the base phrases come from ``license_texts``."""

from riskframe.llm.license_texts import TEMPLATES

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _bench_words(table: str, key: str) -> str:
    return (f"SELECT {key}, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), "
            rf"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM {table}")


DECONTAMINATE = f"""WITH d AS ({_bench_words("documents", "doc_id")}),
b AS (SELECT item_id, ws, least(10, len(ws)) AS size FROM ({_bench_words("benchmark", "item_id")}) x WHERE len(ws) > 0),
bw AS (SELECT DISTINCT item_id, j, size, array_to_string(ws[j + 1:j + size], ' ') AS g
       FROM (SELECT *, unnest(range(0, len(ws) - size + 1)) AS j FROM b) x),
dw AS (SELECT doc_id, p, size, array_to_string(ws[p + 1:p + size], ' ') AS g
       FROM (SELECT *, unnest(range(0, len(ws) - size + 1)) AS p FROM d, (SELECT DISTINCT size FROM b) s WHERE len(ws) >= size) x),
hit AS (SELECT doc_id, p, dw.size, item_id, j FROM dw JOIN bw ON dw.g = bw.g AND dw.size = bw.size),
covered AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(range(p, p + size)) AS place FROM hit) x GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit WHERE item_id IS NOT NULL) x GROUP BY doc_id),
runs AS (SELECT doc_id, CAST(item_id AS VARCHAR) AS item, min(p) AS p, min(j) AS j, count(*) + any_value(size) - 1 AS n
         FROM (SELECT *, p - row_number() OVER (PARTITION BY doc_id, item_id, p - j ORDER BY p) AS run FROM hit) x GROUP BY doc_id, item_id, p - j, run),
longest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, p, item NULLS LAST, j) AS best FROM runs) x WHERE best = 1)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(found.n, 0) AS BIGINT) AS n_items, sha256(coalesce(found.items, '')) AS items_sha256,
       coalesce(covered.n, 0) > 0 AS contaminated, CAST(coalesce(longest.n, 0) AS BIGINT) AS longest_match,
       CAST(longest.p AS BIGINT) AS match_word, longest.item AS match_item, CAST(longest.j AS BIGINT) AS match_item_word
FROM d LEFT JOIN covered ON d.doc_id = covered.doc_id LEFT JOIN found ON d.doc_id = found.doc_id LEFT JOIN longest ON d.doc_id = longest.doc_id"""


_CONTROL = (r"<\\*\|im_start\|>|<\\*\|im_sep\|>|<\\*\|im_end\|>|<\\*\|endoftext\|>|<\\*s>|<\\*/s>|\[\\*INST\]|\[\\*/INST\]"
            r"|<\\*<SYS>>|<\\*</SYS>>")

CHAT_FORMAT = f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || x || chr(10), '' ORDER BY turn NULLS FIRST, r, x)) AS turns_sha256,
  CAST(sum(CASE WHEN r = 'assistant' THEN length(x) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(x, '' ORDER BY turn NULLS FIRST, r, x) FILTER (WHERE r = 'assistant'), '')) AS loss_sha256,
  CAST(sum(12 + length(r) + len(regexp_extract_all(r, '{_CONTROL}')) + 10
           + length(x) + len(regexp_extract_all(x, '{_CONTROL}')) + 10) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id"""


_ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_VENDOR = (r"gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35}"
           r"|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")
_PEM = r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END (?:[A-Z]+ )?PRIVATE KEY-----"


def _matches(kind: int, pattern: str, group: int = 0) -> str:
    return (f"SELECT doc_id, source, {kind} AS kind, regexp_extract_all(text, '{pattern}') AS m, "
            f"regexp_extract_all(text, '{pattern}', {group}) AS v, string_split_regex(text, '{pattern}') AS gap FROM t")


SECRET_SCAN = f"""WITH t AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
k AS ({" UNION ALL ".join([_matches(0, _ASSIGN, 2), _matches(1, "AKIA[A-Z0-9]{16,}"), _matches(2, "[0-9a-f]{24,}"),
                           _matches(3, _VENDOR), _matches(4, _PEM)])}),
i AS (SELECT *, unnest(range(1, len(m) + 1)) AS n FROM k WHERE len(m) > 0),
s AS (SELECT doc_id, source, kind, v[n] AS val, length(m[n]) AS size,
             list_sum(list_transform(gap[1:n], lambda x: length(x))) + list_sum(list_transform(m[1:n], lambda x: length(x))) AS stop FROM i),
c AS (SELECT doc_id, source, kind, val, CAST(stop - size AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM s WHERE kind > 0 OR length(val) >= 6),
f AS (SELECT val, count(DISTINCT coalesce(source, '')) AS owners FROM c GROUP BY val),
j AS (SELECT doc_id, kind, start, stop, ['assign', 'access', 'hex', 'vendor', 'pem'][kind + 1] || ':' || start || ':' || stop AS span,
             CASE WHEN owners >= 3 THEN 'example' WHEN length(val) >= 16 AND len(list_distinct(string_split(val, ''))) >= 8
                  AND regexp_matches(val, '[0-9]') THEN 'live' ELSE 'weak' END AS verdict FROM c JOIN f USING (val)),
a AS (SELECT doc_id, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access,
             count(*) FILTER (WHERE kind = 2) AS n_hex, string_agg(span, ',' ORDER BY start, kind) FILTER (WHERE kind < 3) AS base,
             string_agg(span, ',' ORDER BY start, kind) FILTER (WHERE kind < 3 OR verdict <> 'example') AS spans,
             count(*) FILTER (WHERE verdict = 'live') AS n_live, count(*) FILTER (WHERE verdict = 'example') AS n_example FROM j GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
FROM t LEFT JOIN a ON t.doc_id = a.doc_id"""


# Four base32 letters for every five hex digits of the SHA-1.
WARC = """WITH p AS (SELECT page_id, url, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages),
l AS (SELECT h, max(page_id) AS last FROM p GROUP BY h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda c: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + CAST((CAST('0x' || substr(p.h, CAST(5 * (c // 4) + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (c % 4) AS BIGINT)) & 31 AS BIGINT), 1)), '') AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> last THEN last END AS refers_to, url
FROM p JOIN l ON p.h = l.h"""


def _centroid_rounds(rounds: int) -> str:
    """Every round as two CTEs: who is nearest to which centroid, and the floored means."""
    out = []
    for n in range(rounds + 1):
        out.append(f"a{n} AS MATERIALIZED (SELECT rid, any_value(vec_id) AS vec_id, any_value(v) AS v, min(struct_pack(d := d, c := c)) AS best FROM ("
                   f"SELECT rid, vec_id, v.v AS v, c, CAST(list_sum(list_transform(list_zip(v.v, c{n}.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d "
                   f"FROM v, c{n}) x GROUP BY rid)")
        if n < rounds:
            out.append(f"m{n} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY p) AS v FROM ("
                       f"SELECT best.c AS c, p, sum(v[p]) AS s, count(*) AS n FROM a{n}, range(1, 65) r(p) GROUP BY best.c, p) x GROUP BY c)")
            out.append(f"c{n + 1} AS MATERIALIZED (SELECT c{n}.c, coalesce(m{n}.v, c{n}.v) AS v FROM c{n} LEFT JOIN m{n} ON c{n}.c = m{n}.c)")
    return ",\n".join(out)


CENTROIDS = f"""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id,
  list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h, v) - 1 AS INTEGER) AS c, v
  FROM (SELECT sha256('3:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, v FROM v ORDER BY h, v LIMIT 8) x),
{_centroid_rounds(10)}
SELECT vec_id, best.c AS cluster, best.d AS distance, CAST(sum(best.d) OVER (PARTITION BY best.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c10.v, ',')) AS centroid_sha256
FROM a10 JOIN c10 ON best.c = c10.c"""


def _license_values() -> str:
    """(label, named, share, text) of the templates; the base phrases are written out."""
    rows = [("mit", True, 1.0, "under the mit license"), ("apache-2", True, 1.0, "apache license version 2"), ("cc-by-nc", True, 1.0, "cc by nc")]
    rows += [(t.label, False, t.share, t.text) for t in TEMPLATES if not t.named]
    return ", ".join(f"({n}, '{label}', {named}, {share}, '{text.replace(chr(39), chr(39) * 2)}')"
                     for n, (label, named, share, text) in enumerate(rows))


LICENSES = f"""WITH l(t, label, named, share, text) AS (VALUES {_license_values()}),
lw AS (SELECT t, label, named, share, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM l),
lg AS (SELECT t, q, array_to_string(ws[q + 1:q + 3], ' ') AS g FROM (SELECT t, ws, unnest(range(0, len(ws) - 2)) AS q FROM lw) x),
d AS (SELECT row_number() OVER () AS r, doc_id, ws FROM ({_bench_words("documents", "doc_id")}) x),
dg AS (SELECT r, p, array_to_string(ws[p + 1:p + 3], ' ') AS g FROM (SELECT r, ws, unnest(range(0, len(ws) - 2)) AS p FROM d WHERE len(ws) > 2) x),
hit AS (SELECT r, t, p - q AS diagonal, q FROM dg JOIN lg USING (g)),
v AS (SELECT r, t, diagonal, count(*) AS votes, list(q) AS qs, min(p) AS start, max(p) + 3 AS stop FROM (SELECT *, diagonal + q AS p FROM hit) x GROUP BY r, t, diagonal),
k AS (SELECT v.*, label, named, share, len(ws) AS size FROM v JOIN lw USING (t) WHERE votes >= greatest(1, (len(ws) - 2) // 16)),
n AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY r, t ORDER BY diagonal) > size // 4 THEN 1 ELSE 0 END AS apart FROM k),
m AS (SELECT *, sum(apart) OVER (PARTITION BY r, t ORDER BY diagonal) AS span FROM n),
c AS (SELECT r, t, span, count(DISTINCT w) AS covered FROM (SELECT r, t, span, unnest([q, q + 1, q + 2]) AS w FROM (SELECT r, t, span, unnest(qs) AS q FROM m) x) y GROUP BY r, t, span),
s AS (SELECT r, t, span, any_value(label) AS label, any_value(share) AS share, any_value(size) AS size, min(start) AS start, max(stop) AS stop,
             count(*) FILTER (WHERE named AND votes = size - 2) AS places, min(diagonal) FILTER (WHERE named AND votes = size - 2) AS lo,
             max(diagonal) FILTER (WHERE named AND votes = size - 2) AS hi FROM m GROUP BY r, t, span),
j AS (SELECT s.*, covered / size AS part, stop - start <= 1.5 * size AS compact FROM s JOIN c USING (r, t, span)),
a AS (SELECT r, sum(places) AS n_base, min(lo) AS lo, max(hi) AS hi, list_sort(list(DISTINCT label) FILTER (WHERE places > 0)) AS base,
             list_sort(list(DISTINCT label) FILTER (WHERE places > 0 OR (compact AND part >= share))) AS labels,
             max(part) FILTER (WHERE places > 0 OR compact) AS score, count(*) FILTER (WHERE places > 0 OR (compact AND part >= share)) AS n_spans FROM j GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(lo AS BIGINT) AS first_word, CAST(hi AS BIGINT) AS last_word,
       coalesce(array_to_string(base, ','), '') AS base_labels, coalesce(array_to_string(labels, ','), '') AS labels,
       CAST(coalesce(score, 0) AS DOUBLE) AS score, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans
FROM d LEFT JOIN a USING (r)"""


# CRC-32 from its polynomial, a table entry per byte value; near words as pairs that agree without one letter.
SPELLING = f"""WITH RECURSIVE d AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS i,
  unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[a-z\u00c0-\u00ff]+')) AS w FROM documents),
g AS (SELECT i, w, count(*) AS n FROM d GROUP BY i, w),
tbl AS (SELECT list(c ORDER BY b) AS t FROM (SELECT b, list_reduce(list_prepend(b, range(0, 8)),
        lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(0, 256) r(b)) x),
h AS (SELECT w, n, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(0, CAST(length(hx) // 2 AS BIGINT)),
        lambda k: CAST('0x' || substr(hx, CAST(2 * k + 1 AS BIGINT), 2) AS BIGINT))), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]))) AS h
      FROM (SELECT *, hex(encode(i || ':' || w)) AS hx FROM g) x, tbl),
f AS (SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, CAST(h % length(w) AS BIGINT)) || substr(w, CAST(h % length(w) + 2 AS BIGINT)) ELSE w END AS w, n FROM h),
v AS MATERIALIZED (SELECT w, CAST(sum(n) AS BIGINT) AS n FROM f WHERE length(w) >= 6 GROUP BY w HAVING sum(n) >= 5),
k AS MATERIALIZED (SELECT w, n, k, substr(w, 1, CAST(k - 1 AS BIGINT)) AS a, substr(w, CAST(k + 1 AS BIGINT)) AS b FROM (SELECT w, n, unnest(range(1, length(w) + 1)) AS k FROM v) x),
p AS (SELECT x.w, x.n, y.w AS o, y.n AS m FROM k x JOIN k y ON x.k = y.k AND x.a = y.a AND x.b = y.b AND x.w <> y.w
      UNION SELECT k.w, k.n, v.w, v.n FROM k JOIN v ON v.w = k.a || k.b UNION SELECT v.w, v.n, k.w, k.n FROM k JOIN v ON v.w = k.a || k.b),
s AS (SELECT w, any_value(n) AS n, count(*) AS n_near, max(m) AS m FROM p GROUP BY w),
e AS (SELECT s.w, s.m AS form_n, min(p.o) AS form FROM s JOIN p ON p.w = s.w AND p.m = s.m WHERE s.m >= 5 * s.n GROUP BY s.w, s.m),
z AS (SELECT w, form AS goal FROM e UNION ALL SELECT z.w, e.form FROM z JOIN e ON z.goal = e.w),
r AS (SELECT w, goal AS root FROM z WHERE goal NOT IN (SELECT w FROM e))
SELECT v.w AS word, e.form, coalesce(r.root, v.w) AS root, v.n, CAST(coalesce(s.n_near, 0) AS BIGINT) AS n_near, CAST(e.form_n AS BIGINT) AS form_n
FROM v LEFT JOIN s ON v.w = s.w LEFT JOIN e ON v.w = e.w LEFT JOIN r ON v.w = r.w"""
