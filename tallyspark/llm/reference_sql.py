"""DuckDB SQL for the queries that SQL can express; read by ``queries`` alone."""

from __future__ import annotations

from tallyspark.llm import line_dedup, quality

_WORD = r"[^\x20\x09-\x0D]+"
_ESCAPE = r"'([<\[])(\\*)(/?(?:s>|INST\]))', '\1\\\2\3', 'g'"


def chat(awkward: str) -> str:
    return f"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{awkward}' UNION ALL SELECT -7, 1, 'assistant', '{awkward}'
), marked AS (
  SELECT *, '<s>[INST] ' || regexp_replace(role, {_ESCAPE}) || ' [/INST]' || regexp_replace(text, {_ESCAPE}) || '</s>' AS formatted
  FROM said
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, formatted)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, formatted) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length(formatted))::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id
"""


def urls(rules: tuple[tuple[str, str, str], ...]) -> str:
    values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in rules)
    return f"""
WITH rules(host, path, verdict) AS (VALUES {values}),
cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), named AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2) AS path
  FROM cut
), judged AS (
  SELECT n.host, n.path, arg_max(r.host || r.path, length(r.host || r.path)) AS rule,
    arg_max(r.verdict, length(r.host || r.path)) AS verdict
  FROM (SELECT DISTINCT host, path FROM named) n
  JOIN rules r ON (n.host = r.host OR ends_with(n.host, '.' || r.host)) AND starts_with(n.path, r.path)
  GROUP BY n.host, n.path
)
SELECT page_id, n.host, n.path, rule, coalesce(verdict, 'allow') AS verdict
FROM named n LEFT JOIN judged j ON n.host = j.host AND n.path = j.path
"""


def _weights(column: str, weights: dict[str, float]) -> str:
    if not weights:
        return "1.0::DOUBLE"
    cases = " ".join(f"WHEN {column} = '{k}' THEN {float(v)}::DOUBLE" for k, v in weights.items())
    return f"CASE {cases} ELSE 1.0::DOUBLE END"


def _share(children: str, parent: str, order: str) -> str:
    """The children's share of their parents' budget, by levels that are filled in turn."""
    part = f"PARTITION BY {parent} " if parent else ""
    rank = f"{part}ORDER BY capacity / weight, {order}"
    return f"""(
  SELECT *, CASE WHEN is_full THEN capacity ELSE weight *
      first_value(CASE WHEN NOT is_full THEN level END IGNORE NULLS) OVER ({rank} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) END AS given
  FROM (SELECT *, capacity <= level * weight AS is_full FROM (SELECT *,
      (budget - coalesce(sum(capacity) OVER ({rank} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER ({rank} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
    FROM {children})))"""


def mixing(fraction: float, max_epochs: int, seed: int, domain_weights: dict, lang_weights: dict) -> str:
    number = "coalesce(try_cast(regexp_extract(source, '([0-9]{1,9})$', 1) AS INT), 0) % 4"
    return f"""
WITH docs AS (
  SELECT doc_id, lang, source, CASE WHEN {number} <= 1 THEN 'web' WHEN {number} = 2 THEN 'books' ELSE 'code' END AS domain,
    len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::BIGINT AS words
  FROM documents
), leaves AS (
  SELECT domain, lang, source, sum(words)::BIGINT AS words, (sum(words) * {max_epochs})::DOUBLE AS capacity FROM docs GROUP BY ALL
), tops AS (
  SELECT *, {_weights("domain", domain_weights)} AS weight,
    (SELECT least(sum(capacity), floor(sum(words) * {fraction})) FROM leaves) AS budget
  FROM (SELECT domain, sum(capacity) AS capacity FROM leaves GROUP BY domain)
), top_given AS (SELECT domain, given FROM {_share("tops", "", "domain")}),
middles AS (
  SELECT m.*, {_weights("m.lang", lang_weights)} AS weight, t.given AS budget
  FROM (SELECT domain, lang, sum(capacity) AS capacity FROM leaves GROUP BY domain, lang) m
  JOIN top_given t ON m.domain IS NOT DISTINCT FROM t.domain
), middle_given AS (SELECT domain, lang, given FROM {_share("middles", "domain", "domain, lang")}),
lows AS (
  SELECT l.*, 1.0::DOUBLE AS weight, m.given AS budget FROM leaves l
  JOIN middle_given m ON l.domain IS NOT DISTINCT FROM m.domain AND l.lang IS NOT DISTINCT FROM m.lang
), plan AS (
  SELECT domain, lang, source, words, floor(given)::BIGINT AS given,
    CASE WHEN words > 0 THEN floor(floor(given) / words)::BIGINT ELSE 0 END AS epochs
  FROM {_share("lows", "domain, lang", "domain, lang, source")}
), placed AS (
  SELECT d.*, p.epochs, p.given - p.epochs * p.words AS rest,
    md5(concat_ws(':', {seed}, p.epochs, coalesce(d.doc_id::VARCHAR, ''))) AS place
  FROM docs d JOIN plan p ON d.domain IS NOT DISTINCT FROM p.domain AND d.lang IS NOT DISTINCT FROM p.lang
    AND d.source IS NOT DISTINCT FROM p.source
), counted AS (
  SELECT *, epochs + (sum(words) OVER (PARTITION BY domain, lang, source ORDER BY place, doc_id, words
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= rest)::INT AS passes
  FROM placed
)
SELECT doc_id, domain, lang, source, words, unnest(range(0, passes)) AS epoch FROM counted
"""


def line_dedup_sql() -> str:
    half = ("unnest(['f' || array_to_string(w[1:n // 2], ' '), 'f' || array_to_string(w[1:(n + 1) // 2], ' '), "
            "'l' || array_to_string(w[n - n // 2 + 1:], ' '), 'l' || array_to_string(w[n - (n + 1) // 2 + 1:], ' ')])")
    shared = "len(list_filter(range(1, least(a.n, b.n) + 1), lambda k: {0}[1:k] = {1}[1:k]))"
    first, last = shared.format("a.w", "b.w"), shared.format("a.v", "b.v")
    return f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    unnest(range(0, len(string_split(coalesce(text, ''), chr(10))))) AS number
  FROM documents
), numbered AS (SELECT *, doc_id * 1000000 + number AS spot FROM lines),
firsts AS (SELECT line, min(spot) AS spot FROM numbered WHERE length(line) >= {line_dedup.MIN_CHARS} GROUP BY line),
units AS (
  SELECT spot, CASE WHEN len(string_split(line, ' ')) >= {line_dedup.MIN_UNITS} THEN string_split(line, ' ')
    ELSE list_transform(string_split(replace(line, ' ', chr(1)), ''), lambda c: c || chr(1)) END AS w
  FROM firsts
), words AS (SELECT spot, w, list_reverse(w) AS v, len(w) AS n FROM units WHERE len(w) >= {line_dedup.MIN_UNITS}
), halves AS (SELECT DISTINCT spot, n, {half} AS half FROM words),
pairs AS (
  SELECT DISTINCT x.spot AS later, y.spot AS earlier FROM halves x JOIN halves y ON x.half = y.half
  WHERE y.spot < x.spot AND abs(x.n - y.n) <= 1
), near AS (
  SELECT DISTINCT later AS spot FROM pairs JOIN words a ON a.spot = later JOIN words b ON b.spot = earlier
  WHERE {first} + {last} >= greatest(a.n, b.n) - 1
), judged AS (
  SELECT n.doc_id, n.number, n.line, f.spot IS NOT NULL AND (f.spot < n.spot OR r.spot IS NOT NULL) AS gone
  FROM numbered n LEFT JOIN firsts f ON n.line = f.line LEFT JOIN near r ON f.spot = r.spot
)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY number) FILTER (WHERE NOT gone), '') AS text,
  count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed
FROM judged GROUP BY doc_id
"""


def quality_sql() -> str:
    cell = f"CASE WHEN value > 0 THEN ceil(ln(value) / ln({quality.CELL}::DOUBLE))::INT ELSE -100000 END"
    middle = f"CASE WHEN {{0}} = -100000 THEN 0.0 ELSE 2 * pow({quality.CELL}::DOUBLE, {{0}}) / ({quality.CELL}::DOUBLE + 1) END"
    keys = (("own", "lang, source, "), ("langs", "lang, "), ("every", ""))
    merged = ",\n".join(f"""{name}_cells AS (SELECT {by}measure, cell, sum(n) AS n FROM sketch GROUP BY ALL),
{name} AS (
  SELECT {by}measure, whole AS texts, {middle.format("min(cell) FILTER (WHERE 4 * upto >= whole)")} AS q1,
    {middle.format("min(cell) FILTER (WHERE 4 * upto >= 3 * whole)")} AS q3
  FROM (SELECT *, sum(n) OVER (PARTITION BY {by}measure ORDER BY cell) AS upto, sum(n) OVER (PARTITION BY {by}measure) AS whole
    FROM {name}_cells)
  GROUP BY {by}measure, whole
)""" for name, by in keys)
    slack = ", ".join(f"{s}::DOUBLE" for s, _ in quality.MEASURES.values())
    both = ", ".join(str(b).lower() for _, b in quality.MEASURES.values())

    def pick(q: str) -> str:
        return (f"CASE WHEN o.texts >= {quality.MIN_GROUP} THEN o.{q} WHEN l.texts >= {quality.MIN_GROUP} THEN l.{q} ELSE e.{q} END")

    return f"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w
  FROM documents
), each_word AS (SELECT r, unnest(w) AS word, unnest(range(0, len(w))) AS i FROM docs),
windows AS (
  SELECT r, i, word AS a, lead(word, 1) OVER s AS b, lead(word, 2) OVER s AS c FROM each_word WINDOW s AS (PARTITION BY r ORDER BY i)
), repeated AS (
  SELECT r, count(DISTINCT i + k) AS n_repeat_words
  FROM (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS times FROM windows WHERE c IS NOT NULL), (VALUES (0), (1), (2)) AS t(k)
  WHERE times > 1 GROUP BY r
), line_counts AS (
  SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM docs) WHERE regexp_matches(line, '{_WORD}') GROUP BY r
), counted AS (
  SELECT d.r, doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines
  FROM docs d LEFT JOIN repeated p ON d.r = p.r LEFT JOIN line_counts l ON d.r = l.r
), measured AS (
  SELECT *, [word_chars / n_words, n_symbols / n_words, n_dup_lines / greatest(n_lines, 1), n_repeat_words / n_words] AS m
  FROM counted WHERE n_words > 0
), sketch AS (
  SELECT lang, source, measure, {cell} AS cell, count(*) AS n
  FROM (SELECT lang, source, unnest(m) AS value, unnest(range(0, 4)) AS measure FROM measured) GROUP BY ALL
), {merged}, limits AS (
  SELECT lang, source, measure,
    CASE WHEN [{both}][measure + 1] THEN q1 - {quality.FENCE} * (q3 - q1) - [{slack}][measure + 1] ELSE -1.0 END AS low,
    q3 + {quality.FENCE} * (q3 - q1) + [{slack}][measure + 1] AS high
  FROM (
    SELECT o.lang, o.source, o.measure, {pick("q1")} AS q1, {pick("q3")} AS q3
    FROM own o JOIN langs l ON o.lang IS NOT DISTINCT FROM l.lang AND o.measure = l.measure JOIN every e ON o.measure = e.measure)
), outside AS (
  SELECT DISTINCT r FROM (SELECT r, lang, source, unnest(m) AS value, unnest(range(0, 4)) AS measure FROM measured) v
  JOIN limits t ON v.lang IS NOT DISTINCT FROM t.lang AND v.source IS NOT DISTINCT FROM t.source AND v.measure = t.measure
  WHERE value < low OR value > high
), based AS (
  SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MOST_REPEATED_PCT} * n_words AS base_failed FROM counted
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND o.r IS NULL AS kept
FROM based b LEFT JOIN outside o ON b.r = o.r
"""


def fill_middle() -> str:
    word = "('0x' || substr(digest, {}, 8))::BIGINT"
    return f"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS digest FROM documents
), cut AS (
  SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS tokens,
    {word.format(1)} AS h1, {word.format(9)} AS h2, {word.format(17)} AS h3, {word.format(25)} AS h4
  FROM docs
), placed AS (
  SELECT *, len(tokens)::BIGINT AS n, least(h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)) AS a,
    greatest(h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM cut
), parts AS (
  SELECT doc_id, text, n, form, array_to_string(tokens[:a], '') AS prefix,
    CASE WHEN b > a THEN array_to_string(tokens[a + 1:b], '') ELSE '' END AS middle,
    CASE WHEN n > b THEN array_to_string(tokens[b + 1:], '') ELSE '' END AS suffix
  FROM placed
)
SELECT doc_id, n, form,
  CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""


def prefix_trie() -> str:
    return """
WITH crc AS (
  SELECT list(v ORDER BY i) AS crc_of FROM (
    SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, x: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) AS v
    FROM range(256) t(i))
), turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
  FROM conversations WHERE conv_id IS NOT NULL
), ids AS (
  SELECT conv_id, n, xor(list_reduce(list_concat([4294967295], list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda a, x: xor(a // 256, crc_of[1 + xor(a, x) % 256])), 4294967295) % 9 AS h
  FROM (SELECT conv_id, max(place) AS n FROM turns GROUP BY conv_id), crc
), begun AS (
  SELECT i.conv_id, i.h, b.conv_id AS base, least(i.h, coalesce(b.n, 0)) AS taken
  FROM ids i LEFT JOIN ids b ON b.conv_id = i.conv_id - i.conv_id % 5
), rebuilt AS (
  SELECT b.conv_id, t.place AS depth, t.role, t.text FROM begun b JOIN turns t ON t.conv_id = b.base AND t.place <= b.h
  UNION ALL
  SELECT b.conv_id, t.place - b.h + b.taken, t.role, t.text FROM begun b JOIN turns t ON t.conv_id = b.conv_id AND t.place > b.h
), paths AS (
  SELECT conv_id, depth, strlen(text)::BIGINT AS bytes,
    string_agg(sha256(role) || sha256(text), '') OVER (PARTITION BY conv_id ORDER BY depth ROWS UNBOUNDED PRECEDING) AS node
  FROM rebuilt
  UNION ALL SELECT conv_id, 0, 0, '' FROM ids
), nodes AS (
  SELECT node, left(node, greatest(length(node) - 128, 0)) AS parent, min(depth) AS depth, min(conv_id) AS conv_id,
    count(*) AS n_convs, min(bytes) AS bytes
  FROM paths GROUP BY node
), families AS (
  SELECT parent AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY parent
), sized AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN families USING (node)
), below AS (
  SELECT a.node, sum((s.n_convs - 1) * s.bytes)::BIGINT AS saved_tokens, count(*) FILTER (WHERE s.n_children = 0) AS n_leaves
  FROM (SELECT DISTINCT a.node, b.node AS lower FROM paths a JOIN paths b ON a.conv_id = b.conv_id AND b.depth >= a.depth) a
  JOIN sized s ON s.node = a.lower GROUP BY a.node
), ends AS (
  SELECT node, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends_sha256
  FROM (SELECT conv_id, arg_max(node, depth) AS node FROM paths GROUP BY conv_id) GROUP BY node
)
SELECT s.conv_id, s.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, s.n_convs, s.n_children, n_leaves, saved_tokens,
  coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM sized s JOIN below USING (node) LEFT JOIN ends USING (node) LEFT JOIN nodes p ON s.depth > 0 AND p.node = s.parent
"""
