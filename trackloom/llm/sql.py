"""DuckDB SQL for the queries that it can express."""

from __future__ import annotations

import string

from trackloom.llm import quality, secrets

#: Rows with a number each, as ids may repeat, and their words.
_WORDS = r"""d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
 w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d)"""

OP2 = f"""WITH {_WORDS},
 g AS (SELECT r, i, array_to_string(w[i:i + 4], ' ') AS k FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) > 4)),
 o AS (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, k) > 1),
 c AS (SELECT r, count(DISTINCT i + s) AS n FROM o, range(5) t(s) GROUP BY r),
 l AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT x) AS dup FROM (SELECT r, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]') GROUP BY r),
 m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dup, 0)::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
  coalesce(n_lines, 0) AS n_lines, length(regexp_replace(t, '[^!]', '', 'g')) AS n_bangs FROM w LEFT JOIN c USING (r) LEFT JOIN l USING (r)),
 b AS (SELECT *, ((n_words < 10)::INT + 2 * (100 * n_repeat_words > 20 * n_words)::INT + 4 * (10 * n_symbols > n_words)::INT
  + 8 * (100 * n_dup_lines > 30 * n_lines)::INT + 16 * (word_chars < 2 * n_words OR word_chars > 20 * n_words)::INT + 32 * (2 * n_bangs > n_words)::INT)::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & {quality.policy_mask("v1")} <> 0 AS base_failed,
 fail_bits & {quality.policy_mask("v2")} = 0 AS kept, fail_bits FROM b"""

OP4 = rf"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
 s AS (SELECT DISTINCT r, k FROM (SELECT r, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) WHEN len(w) > 0 THEN ['<' || array_to_string(w, ' ')] ELSE [] END) AS k FROM d)),
 n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
 p AS (SELECT a.r AS a, b.r AS b, count(*) AS both_ FROM s a JOIN s b ON a.k = b.k AND a.r <> b.r GROUP BY ALL),
 e AS (SELECT a, b FROM p JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * both_ >= 85 * (x.n + y.n - both_)),
 c AS (SELECT r AS a, r AS b FROM d UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a),
 m AS (SELECT c.a AS r, min(d.doc_id) AS component_id FROM c JOIN d ON d.r = c.b GROUP BY c.a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM d JOIN m USING (r) LEFT JOIN n USING (r)"""

OP5 = f"""WITH {_WORDS},
 g AS (SELECT r, doc_id, i, array_to_string(w[i:i + 12], ' ') AS k FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM w WHERE len(w) > 12 AND doc_id IS NOT NULL)),
 o AS (SELECT r, i FROM g QUALIFY min(doc_id) OVER (PARTITION BY k) < doc_id),
 c AS (SELECT r, list_distinct(list(i + s)) AS gone FROM o, range(13) t(s) GROUP BY r),
 k AS (SELECT doc_id, w, coalesce(gone, []) AS gone, list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(coalesce(gone, []), i)) AS stay FROM w LEFT JOIN c USING (r))
SELECT doc_id, len(w)::BIGINT AS n_words, len(gone)::BIGINT AS n_removed, sha256(array_to_string(list_transform(stay, lambda i: w[i]), ' ')) AS kept_sha256 FROM k"""

#: t goes through the rounds of a leaf: i is the place where the rest of a group parts, done marks lines of a template.
OP6 = r"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
 l AS (SELECT r, doc_id, text, unnest(string_split(text, chr(10))) AS x, unnest(range(len(string_split(text, chr(10))))) AS p FROM d),
 t AS (SELECT *, list_transform(regexp_extract_all(x, '[^\x20\x09-\x0D]+'), lambda y: CASE WHEN regexp_matches(y, '[0-9@]') THEN '<*>' ELSE y END) AS w FROM l),
 k AS (SELECT *, array_to_string(w, ' ') AS k, len(w) AS n, array_to_string(w[1:3], ' ') AS lead FROM t),
 u AS (SELECT DISTINCT n, lead, k, w FROM k WHERE 25 * (n - 3) >= 100),
 z AS (SELECT n, lead, count(*) AS m FROM u GROUP BY n, lead HAVING count(*) > 1),
 rounds AS (SELECT 'leaf ' || n || ' ' || lead AS g, n, k, w, 0::BIGINT AS fixed, false AS done FROM u JOIN z USING (n, lead) UNION ALL SELECT * FROM (
  WITH live AS (SELECT g, n, k, w FROM rounds WHERE NOT done),
   a AS (SELECT g, k, unnest(w[4:]) AS tok, unnest(range(4, n + 1)) AS i FROM live),
   x AS (SELECT *, sum(c) OVER (PARTITION BY g, i) AS m FROM (SELECT g, i, tok, count(*) AS c FROM a GROUP BY ALL)),
   f AS (SELECT g, i, tok FROM x WHERE m > 1 AND 2 * c > m),
   own AS (SELECT a.g, a.k FROM a JOIN f USING (g, i, tok) JOIN live ON live.g = a.g AND live.k = a.k GROUP BY a.g, a.k, live.n HAVING 100 * count(*) >= 75 * (live.n - 3)),
   s AS (SELECT g, i FROM (SELECT g, i, sum(c * c) AS score FROM x WHERE c >= 2 AND 2 * c <= m GROUP BY g, i) QUALIFY row_number() OVER (PARTITION BY g ORDER BY score DESC, i) = 1),
   rest AS (SELECT live.*, s.i, w[s.i] AS tok, count(*) OVER (PARTITION BY g, w[s.i]) AS c FROM live JOIN s USING (g) ANTI JOIN own USING (g, k))
  SELECT g, n, k, w, (SELECT 3 + count(*) FROM f WHERE f.g = live.g) AS fixed, true AS done FROM live SEMI JOIN own USING (g, k) UNION ALL
  SELECT CASE WHEN c = 1 OR f.tok IS NOT NULL THEN rest.g || '/*' ELSE rest.g || '/' || rest.i || '=' || rest.tok END, n, k, w, 0, false
  FROM rest LEFT JOIN f ON rest.g = f.g AND rest.i = f.i AND rest.tok = f.tok)),
 g AS (SELECT k, g, fixed FROM rounds WHERE done),
 q AS (SELECT r, doc_id, text, x, p, CASE WHEN n = 0 THEN NULL WHEN g.k IS NULL THEN 'line ' || k ELSE g.g END AS tpl,
  CASE WHEN g.k IS NULL THEN n ELSE fixed END AS fixed FROM k LEFT JOIN g USING (k)),
 c AS (SELECT tpl, min(doc_id) AS keeper FROM (SELECT DISTINCT tpl, fixed, doc_id, text FROM q WHERE tpl IS NOT NULL) GROUP BY tpl, fixed
  HAVING count(*) >= 2 AND count(*) * fixed >= 20 AND (fixed >= 5 OR count(*) >= 0.005 * (SELECT count(*) FROM documents)) AND min(doc_id) IS NOT NULL),
 m AS (SELECT q.*, c.tpl IS NOT NULL AND doc_id IS DISTINCT FROM keeper AS gone FROM q LEFT JOIN c USING (tpl)),
 o AS (SELECT r, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, string_agg(x, chr(10) ORDER BY p) FILTER (NOT gone) AS kept FROM m GROUP BY r)
SELECT doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dropped, 0)::BIGINT AS n_dropped, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN o USING (r)"""


def _matches(ord_: int, rule: secrets.Rule) -> str:
    p = rule.pattern.replace("'", "''")
    return f"""SELECT r, {ord_} AS ord, '{rule.kind}' AS kind, i, m, g, length(v[i]) AS chars FROM (SELECT r, regexp_extract_all(t, '{p}') AS m,
 string_split_regex(t, '{p}') AS g, regexp_extract_all(t, '{p}', {rule.value}) AS v, unnest(range(1, len(regexp_extract_all(t, '{p}')) + 1)) AS i FROM d) WHERE length(v[i]) >= {rule.min_chars}"""


def _op7() -> str:
    base = ", ".join(f"'{r.kind}'" for r in secrets.BASE)
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in secrets.BASE)
    outs = ", ".join(f"coalesce(n_{r.kind}, 0)::BIGINT AS n_{r.kind}" for r in secrets.BASE)
    every = " UNION ALL ".join(_matches(k, r) for k, r in enumerate(secrets.RULES))
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents), x AS ({every}),
 s AS (SELECT r, ord, kind, list_sum(list_transform(g[1:i], lambda y: length(y)))::BIGINT + coalesce(list_sum(list_transform(m[1:i - 1], lambda y: length(y))), 0)::BIGINT AS a, length(m[i]) AS n FROM x),
 f AS (SELECT r, {counts}, string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, ord) FILTER (kind IN ({base})) AS base, string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, ord) AS spans FROM s GROUP BY r)
SELECT doc_id, {outs}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN f USING (r)"""


OP9 = """WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
 f AS (SELECT * FROM d WHERE label IS NOT NULL AND v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
 e AS (SELECT a.r AS a, b.r AS b FROM f a JOIN f b ON a.label = b.label AND a.r <> b.r AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
 c AS (SELECT r AS a, r AS b FROM d UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a),
 m AS (SELECT c.a AS r, min(d.vec_id) AS component_id FROM c JOIN d ON d.r = c.b GROUP BY c.a),
 n AS (SELECT a AS r, count(*) AS n FROM e GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept FROM d JOIN m USING (r) LEFT JOIN n USING (r)"""

#: sha256 of the fields, crc32 by shifting 8 times for each digit, and the levels of all trees; -1 in the top tree.
OP11 = f"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, *, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: [ascii(x)::BIGINT] || [-1::BIGINT for i in range(8)]))),
  lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS crc FROM documents),
 h AS (SELECT r, doc_id, CASE WHEN lang IS NULL THEN '-' ELSE '=' || lang END AS tree, {'{fields}'} AS head, text AS t, CASE WHEN xor(crc, 4294967295) % 3 = 0 THEN translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}') ELSE text END AS u FROM d),
 l AS (SELECT r, doc_id, tree, sha256(head || CASE WHEN t IS NULL THEN '-' ELSE strlen(t) || ':' || t END) AS leaf, sha256(head || CASE WHEN u IS NULL THEN '-' ELSE strlen(u) || ':' || u END) AS claim FROM h),
 p AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM l),
 v AS (SELECT tree, 0 AS level, pos, n, leaf AS digest FROM p UNION ALL
  SELECT tree, level + 1, pos // 8, any_value((n + 7) // 8), sha256(string_agg(digest, '' ORDER BY pos)) FROM v WHERE n > 1 GROUP BY tree, level, pos // 8),
 s AS (SELECT tree, digest AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM v WHERE n = 1),
 w AS (SELECT 0 AS level, pos, n, subroot AS digest FROM s UNION ALL SELECT level + 1, pos // 8, any_value((n + 7) // 8), sha256(string_agg(digest, '' ORDER BY pos)) FROM w WHERE n > 1 GROUP BY level, pos // 8),
 root AS (SELECT digest AS root FROM w WHERE n = 1),
 x AS (SELECT a.tree, a.level, a.pos, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS lft, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS rgt
  FROM v a JOIN v b ON a.tree = b.tree AND a.level = b.level AND a.pos // 8 = b.pos // 8 WHERE a.n > 1 GROUP BY ALL),
 y AS (SELECT a.level, a.pos, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS lft, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS rgt
  FROM w a JOIN w b ON a.level = b.level AND a.pos // 8 = b.pos // 8 WHERE a.n > 1 GROUP BY ALL),
 f AS (SELECT r, tree, 0 AS level, pos, claim AS digest, '' AS proof FROM p UNION ALL
  SELECT f.r, f.tree, f.level + 1, f.pos // 8, sha256(lft || f.digest || rgt), f.proof || lft || rgt FROM f JOIN x ON f.tree = x.tree AND f.level = x.level AND f.pos = x.pos),
 g AS (SELECT f.r, 0 AS level, s.pos, f.digest, f.proof FROM (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY r ORDER BY level DESC) = 1) f JOIN s USING (tree) UNION ALL
  SELECT g.r, g.level + 1, g.pos // 8, sha256(lft || g.digest || rgt), g.proof || lft || rgt FROM g JOIN y ON g.level = y.level AND g.pos = y.pos),
 o AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY r ORDER BY level DESC) = 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, digest AS folded_root, digest = root AS verified FROM p JOIN s USING (tree) JOIN o USING (r), root""".replace(
    "{fields}", " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c} END" for c in ("doc_id", "source", "lang", "n_chars"))
)

OP13 = rf"""WITH d AS (SELECT coalesce(lang, 'und') AS lang, string_split_regex(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[.,;:!?
-
]') AS pieces FROM documents),
 p AS MATERIALIZED (SELECT lang, regexp_extract_all(unnest(pieces), '[^ 	]+') AS w FROM d),
 g AS MATERIALIZED (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, range(1, 4) t(k) WHERE len(w) >= k)),
 f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
 n AS MATERIALIZED (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
 c AS MATERIALIZED (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
 e AS MATERIALIZED (SELECT *, array_to_string(w[:c1], ' ') AS head, array_to_string(w[c1 + 1:], ' ') AS tail FROM (SELECT *, unnest(range(1, k)) AS c1 FROM c)),
 u AS MATERIALIZED (SELECT e.*, x.f AS l, y.f AS r, (1000000 * a::HUGEINT * a) // (x.f::HUGEINT * y.f) AS score FROM e JOIN f x ON x.lang = e.lang AND x.phrase = e.head JOIN f y ON y.lang = e.lang AND y.phrase = e.tail),
 b AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c1) = 1),
 m AS MATERIALIZED (SELECT lang, phrase, max(a) AS most FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM c WHERE k = 3) GROUP BY ALL),
 o AS (SELECT b.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b LEFT JOIN m USING (lang, phrase) WHERE k = 3 OR most IS NULL OR 100 * most < 50 * a)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM o JOIN n USING (lang) WHERE rank <= 2000"""

ORACLES = {"op2_quality": OP2, "op4_jaccard": OP4, "op5_substrings": OP5, "op6_lines": OP6, "op7_secrets": _op7(), "op9_embeddings": OP9, "op11_merkle": OP11, "op13_collocations": OP13}
