"""DuckDB SQL of the queries that SQL can express, over the same whole tables."""

from __future__ import annotations

from tidemark.llm import contamination, fill_middle, line_frequency, prefix_trie, production

_WORD = r"[^\x20\x09-\x0D]+"


def _case(column: str, weights: dict[str, int]) -> str:
    return f"CASE {' '.join(f"WHEN {column} = '{name}' THEN {weight}" for name, weight in weights.items())} ELSE 1 END"


def _deal(name: str, nodes: str, parent: str, child: str) -> str:
    """Common tables that deal a parent's budget to its children; ``nodes`` has capacity, weight and budget."""
    order = f"PARTITION BY {parent} ORDER BY capacity / weight, {child} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    return f"""
    {name}_1 AS (SELECT *, coalesce(sum(capacity) OVER ({order}), 0) AS spent,
      sum(weight) OVER (PARTITION BY {parent}) - coalesce(sum(weight) OVER ({order}), 0) AS heavier FROM {nodes}),
    {name}_2 AS (SELECT *, (budget - spent) * weight >= capacity * heavier AS filled FROM {name}_1),
    {name}_3 AS (SELECT *, budget - sum(CASE WHEN filled THEN capacity ELSE 0 END) OVER (PARTITION BY {parent}) AS rest,
      sum(CASE WHEN filled THEN 0 ELSE weight END) OVER (PARTITION BY {parent}) AS sharers FROM {name}_2),
    {name} AS (SELECT * REPLACE (CASE WHEN filled THEN capacity ELSE least(capacity, (rest * weight) // sharers) END AS budget) FROM {name}_3)"""


OP1 = f"""
WITH named AS (SELECT doc_id, coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source,
    regexp_extract(coalesce(source, ''), '(\\d{{1,9}})$', 1) AS digits,
    len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS tokens FROM documents),
  sized AS (SELECT doc_id, CASE WHEN digits = '' THEN 'unknown' ELSE list_extract(['web', 'books', 'code'], CAST(CAST(digits AS BIGINT) % 3 + 1 AS INTEGER)) END AS domain,
    lang, source, tokens FROM named WHERE tokens > 0),
  leaf AS (SELECT domain, lang, source, CAST(sum(tokens) AS BIGINT) AS tokens FROM sized GROUP BY ALL),
  total AS (SELECT CAST(trunc(sum(tokens) * {production.MIX_SHARE}) AS BIGINT) AS budget FROM leaf),
  top AS (SELECT domain, CAST(sum(tokens) * {production.MIX_EPOCHS} AS BIGINT) AS capacity, {_case('domain', production.MIX_WEIGHTS['domain'])} AS weight, any_value(budget) AS budget
    FROM leaf, total GROUP BY domain),
  {_deal('d', 'top', '1', 'domain')},
  mid AS (SELECT leaf.domain, lang, CAST(sum(tokens) * {production.MIX_EPOCHS} AS BIGINT) AS capacity, {_case('lang', production.MIX_WEIGHTS['lang'])} AS weight, any_value(d.budget) AS budget
    FROM leaf JOIN d ON leaf.domain = d.domain GROUP BY leaf.domain, lang),
  {_deal('l', 'mid', 'domain', 'lang')},
  low AS (SELECT leaf.domain, leaf.lang, source, tokens, tokens * {production.MIX_EPOCHS} AS capacity, {_case('source', production.MIX_WEIGHTS['source'])} AS weight, l.budget
    FROM leaf JOIN l ON leaf.domain = l.domain AND leaf.lang = l.lang),
  {_deal('s', 'low', 'domain, lang', 'source')},
  plan AS (SELECT domain, lang, source, CAST(budget // tokens AS BIGINT) AS whole, CAST(budget % tokens AS BIGINT) AS rest FROM s WHERE budget > 0),
  taken AS (SELECT sized.*, whole, rest FROM sized JOIN plan USING (domain, lang, source)),
  cut AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5(concat_ws(':', {production.MIX_SEED}, whole, doc_id)), doc_id) AS upto FROM taken)
SELECT doc_id, domain, lang, source, tokens, epoch FROM (SELECT *, unnest(range(whole)) AS epoch FROM taken)
UNION ALL SELECT doc_id, domain, lang, source, tokens, whole FROM cut WHERE upto <= rest
"""

_SHINGLES = """SELECT DISTINCT id, array_to_string(list_slice(w, i, i + {more}), ' ') AS shingle
    FROM (SELECT id, w, unnest(generate_series(1, greatest(len(w) - {more}, 1))) AS i
      FROM (SELECT {id} AS id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM {table} WHERE {id} IS NOT NULL) WHERE len(w) > 0)"""

OP3 = f"""
WITH d AS ({_SHINGLES.format(id='doc_id', table='documents', more=contamination.SHINGLE_WORDS - 1)}),
  i AS ({_SHINGLES.format(id='item_id', table='benchmark', more=contamination.SHINGLE_WORDS - 1)}),
  n AS (SELECT id, count(*) AS n_shingles FROM i GROUP BY id),
  h AS (SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n_shared FROM d JOIN i USING (shingle) GROUP BY ALL)
SELECT doc_id, item_id, n_shingles, n_shared, n_shared / n_shingles AS containment FROM h JOIN n ON item_id = id
WHERE n_shared >= {contamination.CONTAINMENT} * n_shingles
"""

OP6 = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
  win AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 4), ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
  rep AS (SELECT doc_id, unnest(range(i, i + 5)) AS place FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM win) WHERE n > 1),
  reps AS (SELECT doc_id, count(DISTINCT place) AS n_repeat_words FROM rep GROUP BY doc_id),
  lines AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM d),
  worded AS (SELECT doc_id, source, line, regexp_extract_all(line, '{_WORD}') AS lw FROM lines WHERE regexp_matches(line, '{_WORD}')),
  dups AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM worded GROUP BY doc_id),
  plain AS (SELECT doc_id, source, len(lw) AS n, regexp_replace(lower(array_to_string(lw, ' ')), '[0-9]+', '0', 'g') AS h FROM worded),
  frequent AS (SELECT source, h FROM plain GROUP BY ALL HAVING count(DISTINCT doc_id) > {line_frequency.MAX_DOCUMENTS}),
  removed AS (SELECT doc_id, sum(n) AS removed FROM plain p JOIN frequent f ON p.h = f.h AND p.source IS NOT DISTINCT FROM f.source GROUP BY doc_id),
  base AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    CAST(len(w) - coalesce(removed, 0) AS BIGINT) AS n_words_left
    FROM d LEFT JOIN reps ON d.doc_id = reps.doc_id LEFT JOIN dups ON d.doc_id = dups.doc_id LEFT JOIN removed ON d.doc_id = removed.doc_id),
  judged AS (SELECT *, n_words < {line_frequency.MIN_WORDS} OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base)
SELECT *, NOT base_failed AND n_words_left >= {line_frequency.MIN_WORDS} AND n_words_left >= {line_frequency.MIN_LEFT} * n_words AS kept FROM judged
"""


# One step of crc32 for each bit of each byte of the decimal id.
_CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda acc, b: list_reduce(list_concat([xor(acc, b)], list_transform(range(8), lambda k: 0::BIGINT)),
        lambda r, k: xor(r >> 1, (r & 1) * 3988292384))), 4294967295::BIGINT)"""

OP11 = f"""
WITH placed AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place FROM conversations WHERE conv_id IS NOT NULL),
  said AS (SELECT conv_id, place, sha256(concat(length(role), ':', role, text)) AS said, length(text) AS chars FROM placed),
  ids AS (SELECT conv_id, {_CRC} % {prefix_trie.SHARED_TURNS} AS h, conv_id - conv_id % {prefix_trie.SHARED_BY} AS base FROM (SELECT DISTINCT conv_id FROM placed)),
  ordered AS (
    SELECT i.conv_id, 0 AS part, place, said, chars FROM ids i JOIN said s ON s.conv_id = i.base WHERE place <= h
    UNION ALL SELECT i.conv_id, 1, place, said, chars FROM ids i JOIN said s ON s.conv_id = i.conv_id WHERE place > h),
  turns AS (SELECT conv_id, chars, row_number() OVER w AS depth, sha256(string_agg(said, '') OVER (w ROWS UNBOUNDED PRECEDING)) AS node
    FROM ordered WINDOW w AS (PARTITION BY conv_id ORDER BY part, place)),
  paths AS (SELECT conv_id, 0 AS depth, '' AS node, 0 AS chars FROM ids UNION ALL SELECT conv_id, depth, node, chars FROM turns),
  sized AS (SELECT *, max(depth) OVER (PARTITION BY conv_id) AS n FROM paths),
  nodes AS (SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, min(chars) AS chars, count(*) FILTER (depth < n) AS longer,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (depth = n), '')) AS ends_sha256 FROM sized GROUP BY node, depth),
  parents AS (SELECT x.node, p.node AS parent FROM nodes x JOIN paths p ON p.conv_id = x.conv_id AND p.depth = x.depth - 1),
  children AS (SELECT parent AS node, count(*) AS n_children FROM parents GROUP BY parent),
  above AS (SELECT p.node, sum(CASE WHEN x.longer = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((x.n_convs - 1) * x.chars) AS saved_tokens
    FROM nodes x JOIN paths p ON p.conv_id = x.conv_id AND p.depth <= x.depth GROUP BY p.node)
SELECT x.conv_id, CAST(x.depth AS BIGINT) AS depth, q.conv_id AS parent_conv_id, x.n_convs, coalesce(n_children, 0) AS n_children,
  CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, x.ends_sha256
FROM nodes x JOIN above USING (node) LEFT JOIN parents USING (node) LEFT JOIN nodes q ON q.node = parents.parent LEFT JOIN children c ON c.node = x.node
"""

OP13 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS u,
    sha256(concat('{fill_middle.SEED}:', doc_id)) AS x FROM documents),
  h AS (SELECT *, len(u) AS n, CAST(concat('0x', substr(x, 1, 8)) AS BIGINT) AS h1, CAST(concat('0x', substr(x, 9, 8)) AS BIGINT) AS h2,
    CAST(concat('0x', substr(x, 17, 8)) AS BIGINT) AS h3, CAST(concat('0x', substr(x, 25, 8)) AS BIGINT) AS h4 FROM d),
  f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS low, greatest(h1 % (n + 1), h2 % (n + 1)) AS high,
    CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR h3 % 100 >= {fill_middle.CHANGED_OF_100} THEN 'plain' WHEN h4 % 100 < {fill_middle.SPM_OF_100} THEN 'spm' ELSE 'psm' END AS form FROM h),
  c AS (SELECT *, array_to_string(list_slice(u, 1, low), '') AS a, array_to_string(list_slice(u, low + 1, high), '') AS b, array_to_string(list_slice(u, high + 1, n), '') AS c FROM f)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(a) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(b) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN concat('<P>', a, '<S>', c, '<M>', b) ELSE concat('<S>', c, '<P>', a, '<M>', b) END) AS output_sha256, sha256(text) AS restored_sha256
FROM c
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_token_mix": OP1, "op3_benchmark_leaks": OP3, "op6_line_frequency": OP6, "op11_conversation_trie": OP11, "op13_fill_middle": OP13,
    }
