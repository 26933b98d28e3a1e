"""DuckDB SQL for the operators that SQL can express over whole tables."""

from __future__ import annotations

_ESC = "{0}"
for _c in ("<s>", "</s>", "[INST]", "[/INST]"):
    _ESC = f"replace({_ESC}, '{_c}', '{_c[0]}\\{_c[1:]}')"
_ESC = "'\\' || " + _ESC.replace("{0}", "replace({0}, '\\', '\\\\')")


def _field(x: str) -> str:
    bad = " OR ".join(f"contains({x}, '{c}')" for c in ("<s>", "</s>", "[INST]", "[/INST]"))
    return f"({bad} OR starts_with({x}, '\\'))"


OP2 = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, {_field("role")} OR {_field("text")} AS odd FROM t
), f AS (
  SELECT *, '<s>[INST] ' || CASE WHEN odd THEN {_ESC.format("role")} ELSE role END || ' [/INST]'
    || CASE WHEN odd THEN {_ESC.format("text")} ELSE text END || '</s>' AS line
  FROM e
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, line)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, line) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(line))::BIGINT AS formatted_chars
FROM f GROUP BY conv_id
"""

OP3 = r"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(doc_id::VARCHAR, '')) AS tie,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents
), c AS (
  SELECT *, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS src,
    length(bin(size)) * 8 + ((size * 8) >> (length(bin(size)) - 1)::BIGINT) % 8 AS cls,
    ('0x' || substr(tie, 1, 4))::INTEGER % 64 AS sub
  FROM d
), s AS (
  SELECT source, src, sum(size)::BIGINT AS size FROM c GROUP BY ALL
), w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w FROM s
), l AS (
  SELECT *, size::DOUBLE / w AS r, (sum(size) OVER () * 1.5::DOUBLE - 2 * coalesce(sum(size) OVER o, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS level
  FROM w WINDOW o AS (ORDER BY size::DOUBLE / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), f AS (
  SELECT level FROM l WHERE size * 2 >= level * w ORDER BY r, source IS NULL, source LIMIT 1
), t AS (
  SELECT src, size AS source_size, coalesce(least((size * 2)::DOUBLE, (SELECT level FROM f) * w), (size * 2)::DOUBLE) AS target FROM l
), n AS (
  SELECT c.*, source_size, target, row_number() OVER (PARTITION BY c.src ORDER BY cls, sub, c.size, tie) AS done,
    CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS ratio,
    ('0x' || substr(md5('mix:' || c.src), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM c JOIN t USING (src)
)
SELECT doc_id, size, source_size, target, ((floor(ratio * done + u) - floor(ratio * (done - 1) + u))::BIGINT * size)::BIGINT AS taken FROM n
"""

OP5 = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, text, source FROM documents
), u AS (
  SELECT DISTINCT source, text FROM d WHERE source IS NOT NULL AND text <> ''
), l AS (
  SELECT source, text, unnest(list_distinct(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')))) AS line FROM u
), p AS (
  SELECT source, count(*) AS pages FROM u GROUP BY 1
), c AS (
  SELECT source, line FROM (SELECT source, line, count(*) AS c FROM l WHERE line <> '' GROUP BY ALL) JOIN p USING (source) WHERE c >= 5 AND c > 0.05::DOUBLE * pages
), x AS (
  SELECT rid, doc_id, source, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d
), y AS (
  SELECT x.*, c.line IS NOT NULL AS gone FROM x LEFT JOIN c ON x.source = c.source AND c.line = regexp_replace(raw, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')
), z AS (
  SELECT rid, count(*) FILTER (gone) AS lines_dropped, coalesce(string_agg(raw, chr(10) ORDER BY i) FILTER (NOT gone), '') AS left_text FROM y GROUP BY rid
)
SELECT d.doc_id, coalesce(lines_dropped, 0)::BIGINT AS lines_dropped, length(coalesce(left_text, ''))::BIGINT AS n_chars_left, md5(coalesce(left_text, '')) AS text_md5
FROM d LEFT JOIN z USING (rid)
"""

_LOW = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Shingle sets are compared in full: pairs are counted by the shingles they share, components by walking along the links.
OP4 = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(LOW, '[^\x20\x09-\x0D]+') AS words FROM documents
), g AS (
  SELECT DISTINCT rid, CASE WHEN len(words) >= 3 THEN words[i : i + 2] ELSE words END AS gram
  FROM (SELECT rid, words, unnest(range(1, greatest(len(words) - 2, 1) + 1)) AS i FROM w WHERE len(words) > 0)
), n AS (
  SELECT rid, count(*) AS n FROM g GROUP BY 1
), sets AS (
  SELECT rid, n, md5(string_agg(array_to_string(gram, ' '), chr(10) ORDER BY array_to_string(gram, ' '))) AS content FROM g JOIN n USING (rid) GROUP BY ALL
), cls AS (
  SELECT content, min(rid) AS rid, any_value(n) AS n FROM sets GROUP BY 1
), u AS (
  SELECT g.rid, g.gram FROM g JOIN cls USING (rid)
), links AS (
  SELECT a.rid AS x, b.rid AS y, count(*) AS shared FROM u a JOIN u b ON a.gram = b.gram AND a.rid < b.rid GROUP BY ALL
), e AS (
  SELECT x, y FROM links JOIN cls a ON a.rid = x JOIN cls b ON b.rid = y WHERE 100 * shared >= 90 * (a.n + b.n - shared)
), sym AS (
  SELECT x, y FROM e UNION ALL SELECT y, x FROM e
), reach AS (
  SELECT rid AS v, rid AS r FROM cls UNION SELECT reach.v, sym.y FROM reach JOIN sym ON sym.x = reach.r
), ids AS (
  SELECT cls.rid, min(w.doc_id) AS least FROM cls JOIN sets USING (content) JOIN w ON w.rid = sets.rid GROUP BY 1
), comp AS (
  SELECT v, min(least) AS component_id FROM reach JOIN ids ON ids.rid = reach.r GROUP BY 1
)
SELECT w.doc_id, coalesce(sets.n, 0)::BIGINT AS n_shingles, coalesce(component_id, w.doc_id) AS component_id
FROM w LEFT JOIN sets USING (rid) LEFT JOIN cls USING (content) LEFT JOIN comp ON comp.v = cls.rid
""".replace("LOW", _LOW.format("coalesce(text, '')"))

OP6 = r"""
WITH w AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce('h' || source, 'n') AS host, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), f AS (
  SELECT rid, i, words[i : i + 4] AS five FROM (SELECT rid, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) > 4)
), again AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, five) AS c FROM f) WHERE c > 1
), rep AS (
  SELECT rid, count(DISTINCT i + j) AS n FROM again, (SELECT unnest(range(0, 5)) AS j) GROUP BY 1
), l AS (
  SELECT rid, host, md5(text) AS content, line, regexp_replace(LOW, '[0-9]+', '0', 'g') AS folded,
    len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n
  FROM (SELECT rid, host, text, unnest(string_split(text, chr(10))) AS line FROM w)
), m AS (
  SELECT *, array_to_string(regexp_extract_all(folded, '[^\x20\x09-\x0D]+'), ' ') AS norm FROM l WHERE n > 0
), dup AS (
  SELECT rid, count(*) - count(DISTINCT line) AS n FROM m GROUP BY 1
), often AS (
  SELECT host, norm FROM m GROUP BY ALL HAVING count(DISTINCT content) > 10
), lost AS (
  SELECT rid, sum(m.n) AS n FROM m JOIN often USING (host, norm) GROUP BY 1
), x AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines,
    coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(lost.n, 0)::BIGINT AS lost
  FROM w LEFT JOIN rep USING (rid) LEFT JOIN dup USING (rid) LEFT JOIN lost USING (rid)
), y AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM x
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND 2 * (n_words - lost) >= n_words AS kept FROM y
""".replace("LOW", _LOW.format("line"))

OP7 = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(LOW, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(LOW, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark
), win AS (
  SELECT DISTINCT coalesce(item_id::VARCHAR, '') AS item, least(len(words), 8) AS size, words[i : i + 7] AS win
  FROM (SELECT item_id, words, unnest(range(1, greatest(len(words) - 7, 1) + 1)) AS i FROM b WHERE len(words) > 0)
), size AS (
  SELECT DISTINCT size FROM win
), found AS (
  SELECT rid, i, size, words[i : i + size - 1] AS win
  FROM (SELECT rid, size, words, unnest(range(1, len(words) - size + 2)) AS i FROM d, size WHERE len(words) >= size)
), hit AS (
  SELECT rid, i, found.size, item FROM found JOIN win USING (win)
), words AS (
  SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT rid, i, size FROM hit)) GROUP BY 1
), items AS (
  SELECT rid, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT rid, item FROM hit) GROUP BY 1
)
SELECT doc_id, len(d.words)::BIGINT AS n_words, coalesce(words.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(items.n, 0) >= 2 AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)
""".replace("LOW", _LOW.format("coalesce(text, '')"))

ORACLES = {"op2_chat_format": OP2, "op3_mix_sources": OP3, "op4_ngram_join": OP4, "op5_line_dedup": OP5, "op6_quality_rules": OP6, "op7_decontaminate": OP7}
