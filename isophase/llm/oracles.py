"""DuckDB SQL with the same rows as the operators' queries, where SQL can express them. Written from the definitions."""

from __future__ import annotations

from .debruijn import WIDTH as WORDS
from .mixing import EPOCHS, WEIGHTS
from .preference import END, PART, START
from .suffix_dedup import WIDTH as BYTES

_WORD = r"[^ \t\n\x0b\f\r]+"

#: Order and rendering of turns, then each position of both sides against each other.
OP5 = f"""WITH replies AS (SELECT conv_id, max(turn) AS last FROM conversations WHERE role = 'assistant' GROUP BY 1),
 known AS (SELECT conv_id, last, (SELECT arg_max(c.text, (c.turn, c.text)) FROM conversations c WHERE c.conv_id = r.conv_id AND c.role = 'assistant' AND c.turn < r.last) AS before FROM replies r),
 sides AS (SELECT conv_id, 'chosen' AS side, turn, role, text FROM conversations
  UNION ALL SELECT c.conv_id, 'rejected', turn, role, CASE WHEN role = 'assistant' AND turn = last THEN coalesce(before, '') ELSE text END FROM conversations c LEFT JOIN known USING (conv_id)),
 placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id, side ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) - 1 AS nth FROM sides),
 lined AS (SELECT conv_id, nth, count(*) = 2 AND max(coalesce(role, '')) = min(coalesce(role, '')) AND max(coalesce(text, '')) = min(coalesce(text, '')) AND count(role) <> 1 AND count(text) <> 1 AS same FROM placed GROUP BY 1, 2),
 ends AS (SELECT conv_id, coalesce(min(nth) FILTER (WHERE NOT same), max(nth) + 1) AS shared FROM lined GROUP BY 1),
 rows_ AS (SELECT conv_id, CASE WHEN nth < shared THEN 'prompt' ELSE side END AS kind, CASE WHEN nth < shared THEN nth ELSE nth - shared END AS place, nth >= shared AND role = 'assistant' AS train,
   '{START}' || coalesce(role, '') || chr(10) || coalesce(text, '') || '{END.strip()}' || chr(10) AS body FROM placed JOIN ends USING (conv_id) WHERE nth >= shared OR side = 'chosen'),
 sized AS (SELECT *, place // {PART} AS part, sum(length(body)) OVER (PARTITION BY conv_id, kind, place // {PART} ORDER BY place) AS upto FROM rows_),
 parts AS (SELECT conv_id, kind, part, count(*) AS n_turns, string_agg(body, '' ORDER BY place) AS text,
   coalesce(string_agg(CAST(upto - length(body) + {len(START) + len("assistant") + 1} AS BIGINT) || '-' || CAST(upto AS BIGINT), ',' ORDER BY place) FILTER (WHERE train), '') AS masks FROM sized GROUP BY 1, 2, 3),
 kinds AS (SELECT conv_id, kind FROM ends, (VALUES ('prompt'), ('chosen'), ('rejected')) k(kind))
 SELECT conv_id, kind, CAST(coalesce(part, 0) AS INT) AS part, coalesce(n_turns, 0) AS n_turns, coalesce(text, '') AS text, coalesce(masks, '') AS masks FROM kinds LEFT JOIN parts USING (conv_id, kind)"""

#: Every window's MD5; windows that start more than once; their union by islands; the gaps between these.
OP6 = f"""WITH docs AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
 win AS (SELECT r, s, md5_number(array_slice(b, s + 1, s + {BYTES})) AS x FROM (SELECT r, b, unnest(range(0, octet_length(b) - {BYTES - 1})) AS s FROM docs)),
 twice AS (SELECT x FROM win GROUP BY 1 HAVING count(*) > 1),
 hit AS (SELECT r, s, coalesce(s > lag(s) OVER (PARTITION BY r ORDER BY s) + {BYTES}, true) AS new FROM win SEMI JOIN twice USING (x)),
 island AS (SELECT r, min(s) AS a, max(s) + {BYTES} AS z FROM (SELECT r, s, sum(CAST(new AS INT)) OVER (PARTITION BY r ORDER BY s) AS g FROM hit) GROUP BY r, g),
 edge AS (SELECT r, a, z FROM island UNION ALL SELECT r, octet_length(b), octet_length(b) FROM docs),
 gap AS (SELECT r, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a, z), 0) AS f, a AS t FROM edge),
 kept AS (SELECT r, unhex(string_agg(CASE WHEN f < t THEN hex(array_slice(b, f + 1, t)) ELSE '' END, '' ORDER BY f, t)) AS k FROM gap JOIN docs USING (r) GROUP BY r),
 spans AS (SELECT r, count(*) AS n, sum(z - a) AS gone FROM island GROUP BY r)
 SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(n, 0) AS n_spans, sha256(k) AS kept_sha256 FROM docs JOIN kept USING (r) LEFT JOIN spans USING (r)"""

#: Every window's words; those that a smaller id has too; the words under none of them.
OP7 = f"""WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
 win AS (SELECT r, doc_id, s, array_to_string(w[s:s + {WORDS - 1}], ' ') AS x FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - {WORDS - 2})) AS s FROM docs)),
 hit AS (SELECT r, s FROM (SELECT r, s, doc_id, min(doc_id) OVER (PARTITION BY x) AS first FROM win) WHERE coalesce(doc_id > first, first IS NOT NULL)),
 gone AS (SELECT DISTINCT r, unnest(range(s, s + {WORDS})) AS p FROM hit),
 kept AS (SELECT r, p, w[p] AS word FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS p FROM docs) ANTI JOIN gone USING (r, p)),
 k AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t FROM kept GROUP BY r)
 SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM docs LEFT JOIN k USING (r)"""

_WEIGHT = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(WEIGHTS))

#: Targets by filling sources up in order of what they hold per weight; then one queue per source, merged by finish time.
OP8 = f"""WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS BIGINT) AS size, CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) AS place, coalesce('s' || source, 'n') AS queue FROM documents),
 per AS (SELECT queue, source, CAST(sum(size) AS BIGINT) AS source_size, CAST(CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} {_WEIGHT} END AS DOUBLE) AS weight FROM d GROUP BY 1, 2),
 ratio AS (SELECT *, source_size * {EPOCHS} AS most, source_size * {EPOCHS} / weight AS ratio, CAST(sum(source_size) OVER () AS DOUBLE) AS total, sum(weight) OVER () AS weights FROM per),
 lev AS (SELECT *, (total - (sum(most) OVER o - most)) / (weights - (sum(weight) OVER o - weight)) AS level FROM ratio WINDOW o AS (ORDER BY ratio, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
 goal AS (SELECT queue, source_size, CASE WHEN level >= ratio THEN CAST(most AS DOUBLE) ELSE (SELECT arg_min(level, (ratio, level)) FROM lev WHERE level < ratio) * weight END AS target FROM lev),
 queued AS (SELECT row_number() OVER () AS r, doc_id, queue, size, source_size, target, CAST(sum(size) OVER (PARTITION BY queue ORDER BY place, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto FROM d JOIN goal USING (queue)),
 entry AS (SELECT r, size, sum(size) OVER (ORDER BY (epoch * source_size + upto) / target, queue, epoch, upto ROWS UNBOUNDED PRECEDING) AS acc FROM queued, range({EPOCHS}) e(epoch) WHERE size > 0),
 took AS (SELECT r, CAST(sum(size) AS BIGINT) AS taken FROM entry WHERE acc <= (SELECT sum(size) FROM d) GROUP BY r)
 SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken FROM queued LEFT JOIN took USING (r)"""


def oracle_sql() -> dict[str, str]:
    return {"op5_preferences": OP5, "op6_suffix_dedup": OP6, "op7_substring_dedup": OP7, "op8_mix": OP8}
