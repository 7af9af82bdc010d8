"""DuckDB twins of the corpus queries that SQL can express on whole tables."""

from __future__ import annotations

#: Fixed patterns of the contracts.
_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_CAND = r"[A-Za-z0-9+/_=-]{20,}"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _spans(kind: str, place: int, pattern: str, group: int, keep: str) -> str:
    """Matches of a pattern with their positions, from the pieces between them."""
    return f"""
SELECT doc_id, '{kind}' AS kind, {place} AS place, v AS value,
       CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s,
       length(found[i]) AS size
FROM (SELECT doc_id, found, gaps, unnest(found) AS m, unnest(vals) AS v, generate_subscripts(found, 1) AS i
      FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS found, regexp_extract_all(t, '{pattern}', {group}) AS vals,
                   string_split_regex(t, '{pattern}') AS gaps FROM body WHERE regexp_matches(t, '{pattern}')) a) b
WHERE {keep}"""


SECRETS = f"""
WITH body AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
base AS ({_spans('assign', 0, _ASSIGN, 1, 'length(v) >= 6')}
  UNION ALL {_spans('access', 1, 'AKIA[A-Z0-9]+', 0, 'length(m) >= 20')}
  UNION ALL {_spans('hex', 2, '[0-9a-f]+', 0, 'length(m) >= 24')}),
cand AS (
  SELECT * FROM ({_spans('live', 3, _CAND, 0, "regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]')")}) c
  WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = c.doc_id AND b.s < c.s + c.size AND c.s < b.s + b.size)),
held AS (SELECT DISTINCT doc_id, value FROM (SELECT doc_id, value FROM base UNION ALL SELECT doc_id, value FROM cand) x),
spread AS (
  SELECT value, count(DISTINCT coalesce('s' || source, 'none')) AS owners,
         count(DISTINCT (coalesce('s' || source, 'none'), doc_id)) AS repositories
  FROM held JOIN body USING (doc_id) GROUP BY value),
live AS (SELECT * FROM cand JOIN spread USING (value) WHERE owners < 2 AND repositories < 100),
every AS (SELECT doc_id, kind, place, s, size FROM base UNION ALL SELECT doc_id, kind, place, s, size FROM live),
joined AS (
  SELECT doc_id, string_agg(kind || ':' || s || ':' || (s + size), ',' ORDER BY s, place) FILTER (place < 3) AS base_text,
         string_agg(kind || ':' || s || ':' || (s + size), ',' ORDER BY s, place) AS spans,
         count(*) FILTER (place = 0) AS a, count(*) FILTER (place = 1) AS k, count(*) FILTER (place = 2) AS h,
         count(*) FILTER (place = 3) AS l
  FROM every GROUP BY doc_id),
example AS (SELECT doc_id, count(*) AS n FROM held JOIN spread USING (value) WHERE owners >= 2 OR repositories >= 100 GROUP BY doc_id)
SELECT d.doc_id, coalesce(a, 0) AS n_assign, coalesce(k, 0) AS n_access, coalesce(h, 0) AS n_hex,
       sha256(coalesce(base_text, '')) AS base_sha256, coalesce(spans, '') AS spans,
       coalesce(l, 0) AS n_live, coalesce(n, 0) AS n_example
FROM documents d LEFT JOIN joined USING (doc_id) LEFT JOIN example USING (doc_id)"""

EXACT = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = min(doc_id) OVER same AS kept, sha256(body) AS text_sha256
FROM n WINDOW same AS (PARTITION BY body)"""

_WORDS = f"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}')"

CONTAMINATION = f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
item AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
item_window AS (
  SELECT DISTINCT item_id, size, array_to_string(w[a:a + size - 1], ' ') AS words
  FROM (SELECT item_id, w, least(13, len(w)) AS size, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS a FROM item WHERE len(w) > 0) x),
doc_window AS (
  SELECT doc_id, size, a, array_to_string(w[a:a + size - 1], ' ') AS words
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS a
        FROM d, (SELECT DISTINCT size FROM item_window) z WHERE len(w) >= size) x),
hit AS (SELECT doc_id, size, a, item_id FROM doc_window JOIN item_window USING (size, words)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(a, a + size)) AS p FROM hit) x GROUP BY doc_id),
found AS (
  SELECT doc_id, count(*) AS n, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM hit) x GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(covered.n, 0) AS n_hit, coalesce(found.n, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(covered.n, 0) > 0 AND 20 * coalesce(covered.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)"""


def _leaf(text: str) -> str:
    fields = ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text)
    return "sha256(" + " || ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in fields) + ")"


def _crc32_bits() -> str:
    """crc32 of a decimal number's ASCII text, byte by byte: eight shifts each."""
    step = "c"
    for _ in range(8):
        step = f"list_transform([{step}], lambda v: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END)[1]"
    return (f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), "
            f"lambda ch: ascii(ch)::BIGINT)), lambda a, b: list_transform([xor(a, b)], lambda c: {step})[1]), 4294967295)")


MANIFEST = f"""
WITH RECURSIVE leaves AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce('=' || source, '') AS tree, {_leaf('text')} AS digest,
         CASE WHEN {_crc32_bits()} % 5 = 0 THEN {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS tampered
  FROM documents),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, digest) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n FROM leaves),
low AS (
  SELECT 0 AS level, tree, idx, n, digest FROM placed
  UNION ALL
  SELECT level + 1, tree, idx // 16, max(n + 15) // 16, sha256(string_agg(digest, '' ORDER BY idx))
  FROM low WHERE n > 1 GROUP BY level, tree, idx // 16),
subroots AS (SELECT tree, digest, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n FROM low WHERE n = 1),
high AS (
  SELECT 0 AS level, idx, n, digest FROM subroots
  UNION ALL
  SELECT level + 1, idx // 16, max(n + 15) // 16, sha256(string_agg(digest, '' ORDER BY idx))
  FROM high WHERE n > 1 GROUP BY level, idx // 16),
steps AS (
  SELECT p.rid, l.level, l.idx, l.idx = p.idx // power(16, l.level)::BIGINT AS own, l.digest
  FROM placed p JOIN low l ON l.tree = p.tree AND l.n > 1 AND l.idx // 16 = p.idx // power(16, l.level + 1)::BIGINT
  UNION ALL
  SELECT p.rid, 100 + h.level, h.idx, h.idx = s.idx // power(16, h.level)::BIGINT, h.digest
  FROM placed p JOIN subroots s USING (tree) JOIN high h ON h.n > 1 AND h.idx // 16 = s.idx // power(16, h.level + 1)::BIGINT),
runs AS (
  SELECT rid, row_number() OVER (PARTITION BY rid ORDER BY level) AS k, coalesce(string_agg(digest, '' ORDER BY idx) FILTER (NOT own AND before), '') AS before,
         coalesce(string_agg(digest, '' ORDER BY idx) FILTER (NOT own AND NOT before), '') AS after
  FROM (SELECT *, idx < max(idx) FILTER (own) OVER (PARTITION BY rid, level) AS before FROM steps) x GROUP BY rid, level),
folded AS (
  SELECT rid, 0 AS k, coalesce(tampered, digest) AS cur FROM placed
  UNION ALL
  SELECT f.rid, r.k, sha256(r.before || f.cur || r.after) FROM folded f JOIN runs r ON r.rid = f.rid AND r.k = f.k + 1),
ended AS (SELECT rid, max_by(cur, k) AS cur FROM folded GROUP BY rid),
proofs AS (SELECT rid, string_agg(before || after, '' ORDER BY k) AS path FROM runs GROUP BY rid)
SELECT p.doc_id, p.digest AS leaf, s.digest AS subroot, h.digest AS root, sha256(coalesce(path, '')) AS proof_sha256,
       e.cur AS folded_root, e.cur = h.digest AS verified
FROM placed p JOIN subroots s USING (tree) JOIN high h ON h.n = 1 JOIN ended e USING (rid) LEFT JOIN proofs USING (rid)"""

COLLOCATIONS = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p
  FROM documents),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces),
total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
f AS (
  SELECT lang, k, phrase, count(*) AS f
  FROM (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
        FROM w, (SELECT unnest(range(1, 6)) AS k) sizes WHERE len(w) >= k) x
  GROUP BY lang, k, phrase HAVING count(*) >= 100),
cand AS (SELECT lang, k AS size, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2),
covered AS (
  SELECT lang, phrase, max(a) AS longer
  FROM (SELECT lang, a, unnest(list_transform(range(1, size - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
        FROM cand, (SELECT unnest(range(2, 5)) AS k) sizes WHERE k < size) x GROUP BY lang, phrase),
kept AS (SELECT c.* FROM cand c LEFT JOIN covered v USING (lang, phrase) WHERE v.longer IS NULL OR 100 * v.longer < 100 * a),
cuts AS (
  SELECT c.lang, c.phrase, a, cut, l.f AS l, r.f AS r, n, (1000 * a::HUGEINT * n) // (l.f::HUGEINT * r.f) AS score
  FROM (SELECT *, unnest(range(1, size)) AS cut FROM kept) c
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(w[1:cut], ' ')
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(w[cut + 1:], ' ')
  JOIN total t ON t.lang = c.lang),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM best QUALIFY rank <= 2000"""

NEIGHBOURS = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e,
         embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
         AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS usable
  FROM embeddings),
link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE a.usable AND b.usable AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
low AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT vec_id, (SELECT count(*) FROM link WHERE link.a = vec_id) AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN low ON low.a = vec_id"""
