"""DuckDB statements of the queries that SQL can express, built from the operators' own tables."""

from __future__ import annotations

from . import quality as Q
from .url_filter import RULES

_SPACE = r"[ \t-\r]"


def _quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _failed(rule) -> str:
    parts = []
    if rule.low is not None:
        parts.append(f"{rule.measure} < {rule.low}")
    if rule.high is not None:
        parts.append(f"{rule.measure} > {rule.high}")
    return " OR ".join(parts)


def quality_sql() -> str:
    stops = list(dict.fromkeys(Q.STOP_WORDS + [s.capitalize() for s in Q.STOP_WORDS]))
    base = " OR ".join(_failed(r) for r in Q.BASE)
    every = " OR ".join(_failed(r) for r in (*Q.BASE, *Q.TABLE))
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, list_filter(regexp_split_to_array(t, '{_SPACE}+'), lambda x: x <> '') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \\t-\\r]')) AS l FROM d),
g AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram
      FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
r AS (SELECT rid, i FROM g QUALIFY count(*) OVER (PARTITION BY rid, gram) > 1),
p AS (SELECT rid, count(DISTINCT i + k) AS n FROM r, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid),
m AS (SELECT doc_id, len(w) AS n_words, length(regexp_replace(t, '{_SPACE}+', '', 'g')) AS word_chars,
             length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(p.n, 0) AS n_repeat_words, len(l) AS n_lines,
             len(list_filter(w, lambda x: x IN ({_quoted(stops)}))) AS n_stop_words
      FROM w LEFT JOIN p USING (rid)),
x AS (SELECT *, coalesce(word_chars / nullif(n_words, 0), 0) AS mean_word_length,
             coalesce(n_symbols / nullif(n_words, 0), 0) AS symbol_word_ratio,
             coalesce(n_stop_words / nullif(n_words, 0), 0) AS stop_word_ratio,
             coalesce(n_dup_lines / nullif(n_lines, 0), 0) AS dup_line_ratio,
             coalesce(100 * n_repeat_words / nullif(n_words, 0), 0) AS repeat_word_pct FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       ({base}) AS base_failed, NOT ({every}) AS kept FROM x"""


def _host(url: str) -> str:
    return f"translate(coalesce(regexp_extract({url}, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), ''), " \
           "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _rule(host: str, path: str, column: int) -> str:
    cases = " ".join(
        f"WHEN ({host} = '{r[1]}' OR ends_with({host}, '.{r[1]}')) AND starts_with({path}, '{r[2]}') "
        f"THEN '{r[0] if column == 0 else r[1] + r[2]}'" for r in sorted(RULES, key=lambda r: -len(r[1] + r[2])))
    return f"CASE {cases} END"


def url_sql() -> str:
    node = f"CASE WHEN contains(url, '://') THEN {_host('url')} || regexp_extract(url, '^.*?://[^/?#]*([^#]*)', 1, 's') END"
    return f"""
WITH RECURSIVE p AS (
  SELECT page_id, url, html, {_host('url')} AS host,
         coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') AS path, {node} AS node FROM pages),
tag AS (SELECT url, node, unnest(regexp_extract_all(html, '<(?:link|meta)\\b[^>]*>', 0, 'is')) AS tag FROM p),
raw AS (SELECT url AS own, node, CASE
    WHEN regexp_matches(tag, '^<link\\b.*\\brel\\s*=\\s*["'']?canonical\\b', 'is')
      THEN regexp_extract(tag, '\\bhref\\s*=\\s*["'']?([^"''\\s>]+)', 1, 'is')
    WHEN regexp_matches(tag, '^<meta\\b.*\\bhttp-equiv\\s*=\\s*["'']?refresh\\b', 'is')
      THEN regexp_extract(tag, '\\burl\\s*=\\s*["'']?([^"''\\s>]+)', 1, 'is') END AS target FROM tag),
full_ AS (SELECT node, CASE WHEN contains(target, '://') THEN target WHEN starts_with(target, '//') THEN 'http:' || target
    WHEN starts_with(target, '/') THEN regexp_extract(own, '^(.*?://)', 1, 's') || {_host('own')} || target END AS url FROM raw),
edge AS (SELECT DISTINCT node AS u, {node} AS v FROM full_ WHERE url IS NOT NULL AND node IS NOT NULL),
both_ AS (SELECT u, v FROM edge WHERE v IS NOT NULL AND u <> v UNION SELECT v, u FROM edge WHERE v IS NOT NULL AND u <> v),
reach AS (SELECT u, v FROM both_ UNION SELECT reach.u, both_.v FROM reach JOIN both_ ON reach.v = both_.u),
said AS (SELECT u, v, {_host("'x://' || v")} AS h, regexp_extract('x://' || v, '^.*?://([^/?#]*)([^?#]*)', 2, 's') AS q FROM reach),
alias AS (SELECT u AS node, bool_or({_rule('h', 'q', 0)} = 'block') AS blocked, bool_or({_rule('h', 'q', 0)} = 'allow') AS allowed
          FROM said GROUP BY u)
SELECT page_id, host, path, {_rule('host', 'path', 1)} AS rule,
       coalesce({_rule('host', 'path', 0)}, CASE WHEN coalesce(blocked, false) AND NOT coalesce(allowed, false) THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN alias USING (node)"""


def fill_middle_sql() -> str:
    number = "CAST('0x' || substr(h, {}, 8) AS BIGINT)"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n,
                  sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
c AS (SELECT doc_id, t, n, {number.format(1)} % (n + 1) AS x, {number.format(9)} % (n + 1) AS y,
             t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>')
               OR {number.format(17)} % 100 >= 90 AS plain, {number.format(25)} % 100 < 20 AS spm FROM d),
p AS (SELECT *, substring(t, 1, least(x, y)) AS prefix, substring(t, least(x, y) + 1, greatest(x, y) - least(x, y)) AS middle,
             substring(t, greatest(x, y) + 1) AS suffix FROM c)
SELECT doc_id, n, CASE WHEN plain THEN 'plain' WHEN spm THEN 'spm' ELSE 'psm' END AS form,
       CASE WHEN NOT plain THEN least(x, y) END AS prefix_chars, CASE WHEN NOT plain THEN greatest(x, y) - least(x, y) END AS middle_chars,
       sha256(CASE WHEN plain THEN t WHEN spm THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle
                   ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256 FROM p"""
