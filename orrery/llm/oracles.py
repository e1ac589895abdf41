"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

ORACLES["op7_quality_rules"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT rid, doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM d
), win AS (
  SELECT rid, i, list_slice(ws, i, i + 7) AS g
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)
), twice AS (
  SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, g) > 1
), cover AS (
  SELECT rid, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest(range(0, 8)) AS k) GROUP BY rid
), m AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN cover USING (rid)
), b AS (
  SELECT *, ((n_words < 20)::BIGINT + 2 * (100 * n_repeat_words > 30 * n_words)::BIGINT
     + 4 * (10 * word_chars < 15 * n_words)::BIGINT + 8 * (word_chars > 20 * n_words)::BIGINT
     + 16 * (4 * n_symbols > n_words)::BIGINT + 32 * (100 * n_dup_lines > 60 * n_lines)::BIGINT)::BIGINT AS failed_bits
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed_bits,
       (failed_bits & 3) <> 0 AS base_failed, failed_bits = 0 AS kept
FROM b
"""

ORACLES["op6_warc"] = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages
), g AS (
  SELECT html, max(page_id) AS first FROM p WHERE strlen(html) >= 1000 GROUP BY html
)
SELECT page_id, strlen(p.html)::BIGINT AS payload_bytes, sha1(p.html) AS payload_digest,
       CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN g ON p.html = g.html
"""

ORACLES["op5_near_dedup"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), g AS (
  SELECT doc_id, len(ws) AS w, ws, CASE WHEN len(ws) < 5 THEN 1 ELSE len(ws) - 4 END AS runs FROM d WHERE len(ws) > 0
), x AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 4), ' ') AS v FROM (SELECT doc_id, ws, unnest(range(1, runs + 1)) AS i FROM g)
), n AS (
  SELECT doc_id, count(*) AS n FROM x GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM x a JOIN x b ON a.v = b.v AND a.doc_id < b.doc_id GROUP BY 1, 2
), e AS (
  SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)
), link AS (
  SELECT a, b FROM e UNION ALL SELECT b, a FROM e
), reach(a, b) AS (
  SELECT a, b FROM link UNION SELECT r.a, t.b FROM reach r JOIN link t ON r.b = t.a
), lowest AS (
  SELECT a, min(b) AS b FROM reach GROUP BY a
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(least(d.doc_id, m.b), d.doc_id)::BIGINT AS component_id,
       d.doc_id = coalesce(least(d.doc_id, m.b), d.doc_id) AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN lowest m ON m.a = d.doc_id
"""

#: crc32 of the ASCII text of a number, bit by bit.
_CRC32 = """xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT,
    list_transform(string_split(x::VARCHAR, ''), lambda ch: ascii(ch)::UBIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), list_transform(range(8), lambda i: 0::UBIGINT)),
      lambda v, i: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384::UBIGINT) ELSE v // 2 END)))"""


def _fields(text: str) -> str:
    one = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')"
    return "sha256(" + " || ".join(one.format(f) for f in ("doc_id", "source", "lang", "n_chars", text)) + ")"


_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

# level: the digests of all trees, level by level; g is the source, or -1 for the tree of subroots
ORACLES["op11_merkle_manifest"] = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '') AS s, source IS NOT NULL AS named, {_fields("text")} AS leaf,
         CASE WHEN doc_id IS NOT NULL AND ({_CRC32.replace("x::VARCHAR", "doc_id::VARCHAR")}) % 5 = 0 THEN {_fields(_LOWERED)} END AS altered
  FROM documents
), p AS (
  SELECT *, dense_rank() OVER (ORDER BY named, s) - 1 AS g, row_number() OVER (PARTITION BY named, s ORDER BY doc_id, leaf) - 1 AS place FROM d
), lower(g, level, place, digest, n) AS (
  SELECT g, 0, place, leaf, count(*) OVER (PARTITION BY g) FROM p
  UNION ALL
  SELECT *, count(*) OVER (PARTITION BY g) FROM (
    SELECT g, level + 1 AS level, place // 16 AS place, sha256(string_agg(digest, '' ORDER BY place)) AS digest
    FROM lower WHERE n > 1 GROUP BY g, level, place // 16)
), subs AS (
  SELECT g, digest, level AS height FROM lower WHERE n = 1
), upper_(level, place, digest, n) AS (
  SELECT 0, g, digest, count(*) OVER () FROM subs
  UNION ALL
  SELECT *, count(*) OVER () FROM (
    SELECT level + 1 AS level, place // 16 AS place, sha256(string_agg(digest, '' ORDER BY place)) AS digest
    FROM upper_ WHERE n > 1 GROUP BY level, place // 16)
), root AS (
  SELECT digest AS root, level AS height FROM upper_ WHERE n = 1
), runs AS (
  SELECT g, level, place // 16 AS run, list(digest ORDER BY place) AS digests FROM lower WHERE n > 1 GROUP BY ALL
  UNION ALL
  SELECT -1, level, place // 16, list(digest ORDER BY place) FROM upper_ WHERE n > 1 GROUP BY ALL
), way AS (
  SELECT p.doc_id, p.g, p.place, unnest(range(height)) AS level, p.g AS tree, p.place AS spot, 0 AS below FROM p JOIN subs USING (g)
  UNION ALL
  SELECT p.doc_id, p.g, p.place, unnest(range(root.height)), -1, p.g, subs.height FROM p JOIN subs USING (g), root
), steps AS (
  SELECT w.g, w.place, below + w.level AS step, digests, (spot // (16 ** w.level)::BIGINT) % 16 AS i
  FROM way w JOIN runs r ON r.g = tree AND r.level = w.level AND run = spot // (16 ** (w.level + 1))::BIGINT
), proof AS (
  SELECT g, place, list(struct_pack(a := array_to_string(digests[: i], ''), b := array_to_string(digests[i + 2 :], '')) ORDER BY step) AS segments
  FROM steps GROUP BY g, place
), fold(g, place, k, cur) AS (
  SELECT g, place, 0, coalesce(altered, leaf) FROM p
  UNION ALL
  SELECT f.g, f.place, k + 1, sha256(segments[k + 1].a || cur || segments[k + 1].b)
  FROM fold f JOIN proof USING (g, place) WHERE k < len(segments)
), ends AS (
  SELECT g, place, arg_max(cur, k) AS folded_root FROM fold GROUP BY g, place
)
SELECT doc_id, leaf, subs.digest AS subroot, root, folded_root, folded_root = root AS verified,
       sha256(coalesce(array_to_string(list_transform(segments, lambda seg: seg.a || seg.b), ''), '')) AS proof_sha256
FROM p JOIN subs USING (g) JOIN ends USING (g, place) LEFT JOIN proof USING (g, place), root
"""

_ESCAPED = r"regexp_replace(t, '([\[<])(\\*)(/?s>|/?INST\]|/?SYS\]|OUT\]|ROLE:[0-9A-F]*\]|/ROLE\])', '\1\2\\\3', 'g')"
_MARKS = """CASE role WHEN 'user' THEN 15 WHEN 'system' THEN 13 WHEN 'assistant' THEN 11 ELSE 16 + 2 * strlen(role) END"""

ORACLES["op13_chat_format"] = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS t FROM conversations
  UNION ALL
  SELECT -1, unnest([0, 1]), unnest(['user', 'assistant']), '</s>[INST] ok [/INST]'
), x AS (
  SELECT *, length({_ESCAPED}) + {_MARKS} AS size FROM c
), a AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn, role, t) AS turns,
         coalesce(string_agg(t, '' ORDER BY turn, t) FILTER (role = 'assistant'), '') AS learnt, 3 + sum(size) AS formatted_chars
  FROM x GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(learnt)::BIGINT AS loss_chars, sha256(learnt) AS loss_sha256,
       formatted_chars::BIGINT AS formatted_chars
FROM a
"""

# m: places where a word is as one q words before, of q up to a quarter of the text; t: its stretches
ORACLES["op12_periodic_runs"] = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws,
         CASE WHEN doc_id IS NOT NULL THEN ({_CRC32.replace("x::VARCHAR", "doc_id::VARCHAR")})::BIGINT ELSE 1 END AS h
  FROM documents
), e AS (
  SELECT *, len(ws) AS n, CASE WHEN len(ws) > 0 THEN (h // 10) % len(ws) END AS a FROM d
), f AS (
  SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM e
), w AS (
  SELECT rid, n, unnest(range(n)) AS i, unnest(CASE WHEN h % 10 = 0 THEN
    list_transform(range(n), lambda k: ws[CASE WHEN k < a THEN k ELSE a + (k - a) % p END + 1]) ELSE ws END) AS v
  FROM f WHERE n > 0
), m AS (
  SELECT x.rid, x.i - y.i AS q, x.i FROM w x JOIN w y ON x.rid = y.rid AND x.v = y.v AND y.i < x.i AND 4 * (x.i - y.i) <= x.n
), s AS (
  SELECT rid, q, min(i) - q AS start, count(*) + q AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS g FROM m) GROUP BY rid, q, g
), t AS (
  SELECT * FROM s WHERE length >= greatest(6, 4 * q)
), r AS (
  SELECT * FROM t WHERE NOT EXISTS (
    SELECT 1 FROM t u WHERE u.rid = t.rid AND u.q < t.q AND u.start <= t.start AND u.start + u.length >= t.start + t.length)
), b AS (
  SELECT rid, count(*) AS n_runs, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS runs,
         min(struct_pack(l := -length, s := start, q := q)) AS best
  FROM r GROUP BY rid
), gone AS (
  SELECT DISTINCT rid, unnest(range(start + q, start + length)) AS i FROM r
), kept AS (
  SELECT rid, string_agg(v, ' ' ORDER BY i) AS words FROM w ANTI JOIN gone USING (rid, i) GROUP BY rid
)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.s AS start, -best.l AS length, best.q AS period,
       (1000 * -best.l) // best.q AS exponent_milli, sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(words, '')) AS collapsed_sha256
FROM d LEFT JOIN b USING (rid) LEFT JOIN kept USING (rid)
"""
