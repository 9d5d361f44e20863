"""DuckDB SQL for the numbered queries that SQL can express."""

from __future__ import annotations

from .quality_rules import RULES, STOP_WORDS
from .url_filters import DAMPING, ROUNDS, THRESHOLD
from .url_filters import RULES as URL_RULES
from .vector_codes import ENTRIES, PARTS
from .vector_codes import ROUNDS as CODE_ROUNDS

_WHITE = r"[\x20\x09-\x0D]"
_SPACES = r"chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def quality_rules() -> str:
    stop = ", ".join(f"'{w}'" for w in sorted({w for ws in STOP_WORDS.values() for w in ws}))
    bounds = " AND ".join(f"{m} {op} {v}" for m, low, high in RULES
                          for op, v in ((">=", low), ("<=", high)) if v is not None)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: length(trim(x, {_SPACES})) > 0) AS ls FROM d),
win AS (SELECT doc_id, i, ws[i:i+4] AS g FROM w, unnest(range(1, len(ws) - 3)) AS r(i)),
rep AS (SELECT doc_id, i FROM win
        QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
cov AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM rep, unnest(range(0, 5)) AS r(j) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws) AS n_words,
             coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS word_chars,
             length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols,
             len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words,
             length(t) - length(translate(t, '{_UP}', '')) AS upper, length(t) - length(translate(t, '|', '')) AS bars,
             len(ls) AS n_lines, length(t) AS chars, len(list_filter(ws, lambda x: lower(x) IN ({stop}))) AS stops
      FROM w LEFT JOIN cov USING (doc_id)),
r AS (SELECT *, word_chars / greatest(n_words, 1) AS mean_word_chars, n_symbols / greatest(n_words, 1) AS symbol_ratio,
             upper / greatest(chars, 1) AS upper_ratio, bars / greatest(n_words, 1) AS bar_ratio,
             greatest(n_words, 1) / (1 + stops) AS words_per_stop_word, n_dup_lines / greatest(n_lines, 1) AS dup_line_ratio,
             n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND {bounds} AS kept FROM r"""


def line_dedup() -> str:
    key = f"translate(trim(line, {_SPACES}), '{_UP}', '{_LOW}')"
    return f"""
WITH l AS (SELECT doc_id, pos, line, {key} AS k FROM
             (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
             unnest(ls) WITH ORDINALITY AS u(line, pos)),
bad AS (SELECT k, max(doc_id) AS keep FROM l WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
f AS (SELECT l.*, bad.k IS NOT NULL AND doc_id <> keep AS gone FROM l LEFT JOIN bad USING (k))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM f GROUP BY doc_id"""


def ngram_join() -> str:
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'),
                                             '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, ws[i:i+3] AS g FROM w, unnest(range(1, greatest(len(ws) - 2, 2))) AS r(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT x, y FROM p JOIN n a ON x = a.doc_id JOIN n b ON y = b.doc_id WHERE 100 * c >= 85 * (a.n + b.n - c)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT reach.x, e.y FROM reach JOIN e ON reach.y = e.x)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM documents LEFT JOIN n USING (doc_id)
JOIN (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x) USING (doc_id)"""


def _walk(name: str, edges: str, verdict: str) -> str:
    """CTEs for the rounds of one personalised walk."""
    parts = [f"""{name}s AS (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS p FROM {edges}),
{name}0 AS (SELECT host, count(*) / (SELECT count(*) FROM ruled WHERE says = '{verdict}') AS s FROM ruled WHERE says = '{verdict}' GROUP BY host)"""]
    for k in range(1, ROUNDS + 1):
        parts.append(f"""{name}{k} AS (SELECT host, sum(s) AS s FROM (SELECT dst AS host, {DAMPING} * p * s AS s
  FROM {name}s JOIN {name}{k - 1} ON src = host UNION ALL SELECT host, {1 - DAMPING!r} * s FROM {name}0) GROUP BY host)""")
    return ",\n".join(parts)


def url_filters() -> str:
    def case(value):
        whens = []
        for says, text in sorted(URL_RULES, key=lambda r: -len(r[1])):
            name, _, rest = text.partition("/")
            whens.append(f"WHEN (host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '/{rest}') "
                         f"THEN '{says if value else text}'")
        return f"CASE {' '.join(whens)} END"

    return f"""
WITH u AS (SELECT page_id, html, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS a FROM pages),
h AS (SELECT page_id, html, translate(regexp_extract(coalesce(a, ''), '^[^/?#]*'), '{_UP}', '{_LOW}') AS host,
             regexp_extract(coalesce(a, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM u),
v AS (SELECT *, {case(False)} AS rule, {case(True)} AS says FROM h),
ruled AS (SELECT host, says FROM v WHERE host <> '' AND rule IS NOT NULL),
linked AS (SELECT host AS src, translate(dst, '{_UP}', '{_LOW}') AS dst, count(*) AS n FROM v,
  unnest(regexp_extract_all(html, '(?:href|src)\\s*=\\s*["'']?(?:[A-Za-z]+:)?//([^"''\\s>/?#]+)', 1)) AS x(dst) GROUP BY ALL),
hosts AS (SELECT DISTINCT host FROM (SELECT host FROM v UNION ALL SELECT dst FROM linked) WHERE host <> ''),
steps AS (SELECT DISTINCT array_to_string(l[i:], '.') AS a, array_to_string(l[i+1:], '.') AS b
  FROM (SELECT string_split(host, '.') AS l FROM hosts), unnest(range(1, len(l) - 1)) AS r(i)),
edges AS MATERIALIZED (SELECT src, dst, sum(n)::DOUBLE AS n FROM (SELECT * FROM linked WHERE src <> '' AND dst <> '' AND src <> dst
  UNION ALL SELECT a, b, 1 FROM steps UNION ALL SELECT b, a, 1 FROM steps) GROUP BY ALL),
back AS (SELECT dst AS src, src AS dst, n FROM edges),
{_walk('good', 'edges', 'allow')},
{_walk('bad', 'back', 'block')}
SELECT page_id, v.host, path, rule, coalesce(says, CASE WHEN coalesce(g.s, 0) - coalesce(b.s, 0) >= {THRESHOLD}
  THEN 'allow' ELSE 'block' END) AS verdict
FROM v LEFT JOIN good{ROUNDS} g ON v.host = g.host LEFT JOIN bad{ROUNDS} b ON v.host = b.host"""


def filter_audit() -> str:
    bit = "(1 << (ascii(substr(filter_order, step, 1)) - 65))"
    return f"""
WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
                  regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
l AS (SELECT doc_id, coalesce(max(quality = 1), false) AS good, coalesce(max(toxic = 1), false) AS toxic FROM labels GROUP BY ALL),
m AS (SELECT w.doc_id, part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
        (len(ws) < 200)::INT + 2 * (100 * len(list_distinct(ws)) < 50 * len(ws))::INT
        + 4 * (100 * (length(t) - length(translate(t, '{_UP}', ''))) > 2 * length(t))::INT
        + 8 * regexp_matches(t, '[#$%&*|]')::INT
        + 16 * coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY t), false)::INT AS mask
      FROM w LEFT JOIN l USING (doc_id)),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM f a, f b, f c, f d, f e
      WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, step, {bit} AS bit,
             coalesce(list_sum([1 << (ascii(substr(filter_order, j, 1)) - 65) for j in range(1, step)]), 0)::INT AS state
      FROM o, unnest(range(1, 6)) AS r(step)),
r AS (SELECT part, filter_order, step, bit, sum(n) FILTER (mask & (state | bit) = 0) AS kept,
             sum(n) FILTER (mask & state = 0 AND mask & bit > 0) AS removed,
             sum(n) FILTER (mask & state > 0 AND mask & bit > 0) AS redundant, sum(n) FILTER (mask = bit) AS unique_fails,
             sum(good) FILTER (mask & state = 0 AND mask & bit > 0) AS good_lost,
             sum(toxic) FILTER (mask & state = 0 AND mask & bit > 0) AS toxic_lost
      FROM c, s GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, {", ".join(f"coalesce({x}, 0)::BIGINT AS {x}" for x in
       ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"))},
       coalesce(sum(removed) OVER (PARTITION BY part, bit), 0)::BIGINT AS shapley FROM r"""


def vector_codes() -> str:
    parts = [f"""v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, part, v[part * (len(v) // {PARTS}) + 1:(part + 1) * (len(v) // {PARTS})] AS x
  FROM v, unnest(range({PARTS})) AS r(part)),
b0 AS MATERIALIZED (SELECT part, x, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry
  FROM p JOIN (SELECT vec_id FROM v ORDER BY vec_id LIMIT {ENTRIES}) USING (vec_id))"""]
    for k in range(CODE_ROUNDS + 1):
        parts.append(f"""a{k} AS MATERIALIZED (SELECT vec_id, part, x, e[2] AS entry, e[1] AS d FROM (
  SELECT vec_id, p.part, any_value(p.x) AS x, min([list_sum([(q[1] - q[2]) ** 2 for q in list_zip(p.x, b.x)])::BIGINT, entry]) AS e
  FROM p JOIN b{k} b USING (part) GROUP BY ALL))""")
        if k < CODE_ROUNDS:
            parts.append(f"""m{k} AS (SELECT part, entry, list(y ORDER BY j) AS x FROM (
  SELECT part, entry, j, floor(sum(x[j])::DOUBLE / count(*))::BIGINT AS y FROM a{k}, unnest(range(1, len(x) + 1)) AS r(j) GROUP BY ALL) GROUP BY ALL),
b{k + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m{k}.x, b{k}.x) AS x FROM b{k} LEFT JOIN m{k} USING (part, entry))""")
    return f"""
WITH {", ".join(parts)},
c AS (SELECT vec_id, string_agg(lpad(lower(hex(entry)), 2, '0'), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{CODE_ROUNDS} GROUP BY ALL),
s AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{CODE_ROUNDS})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM c JOIN v USING (vec_id), s"""


ORACLE: dict[str, str] = {
    "op12_vector_codes": vector_codes(),
    "op11_filter_audit": filter_audit(),
    "op2_quality_rules": quality_rules(),
    "op5_url_filters": url_filters(),
    "op6_ngram_join": ngram_join(),
    "op8_line_dedup": line_dedup(),
}
