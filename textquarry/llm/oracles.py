"""DuckDB SQL of the operators that SQL can express."""

from __future__ import annotations

from .common import LOWER, UPPER
from .mixing import SLACK as MIX_SLACK
from .quality_rules import FENCE, GAMMA, PRIOR_DOCS, SLACK

_ITEM = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _windows(k: str) -> str:
    return f"list_transform(range(1, len(w) - {k} + 2), lambda i: array_to_string(w[i:i + {k} - 1], ' '))"


OP6 = f"""
WITH dw AS (SELECT doc_id, {_ITEM} AS w FROM documents),
iw AS (SELECT item_id, w, least(8, len(w)) AS k FROM (SELECT item_id, {_ITEM} AS w FROM benchmark) WHERE len(w) > 0),
iwin AS (SELECT DISTINCT item_id, k, unnest({_windows('k')}) AS win FROM iw),
dwin AS (SELECT doc_id, k, unnest(range(0, len(w) - k + 1)) AS pos, unnest({_windows('k')}) AS win FROM dw, (SELECT DISTINCT k FROM iwin) WHERE len(w) >= k),
hits AS (SELECT DISTINCT doc_id, k, pos, win FROM dwin WHERE win IN (SELECT win FROM iwin)),
cover AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + k)) AS p FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS names FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hits JOIN iwin USING (win)) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM dw LEFT JOIN cover USING (doc_id) LEFT JOIN found USING (doc_id)
"""

OP7 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, source, len({_WORDS})::BIGINT AS size, md5(doc_id::VARCHAR) AS place FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY source),
s1 AS (SELECT *, [5.0, 2.0, 1.0][(rank % 3 + 1)::INT]::DOUBLE AS w, 3.0::DOUBLE * source_size AS cap FROM s0),
s2 AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level FROM s1 WINDOW b AS (ORDER BY cap / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (SELECT *, cap < level * w AS f FROM s2),
s AS (SELECT source, source_size, f, CASE WHEN f THEN cap ELSE w * (SELECT (sum(source_size) - coalesce(sum(cap) FILTER (f), 0)) / sum(w) FILTER (NOT f) FROM s3) END AS target FROM s3),
cells AS (SELECT source, length(bin(size)) AS band, sum(size)::DOUBLE AS m FROM d WHERE size > 0 GROUP BY ALL),
mean AS (SELECT coalesce(sum(m), 0) AS n, sum(m * band) / sum(m) AS b FROM cells),
off AS MATERIALIZED (SELECT c.source, c.m, c.band - b AS z, target, source_size, f FROM cells c JOIN s ON c.source IS NOT DISTINCT FROM s.source, mean),
fixed AS (SELECT coalesce(sum(3.0 * m * z), 0) AS q FROM off WHERE f),
steps AS (
  SELECT 0 AS k, source, ln(target / source_size) AS lam, 0.0::DOUBLE AS theta FROM s WHERE NOT f AND target > 0 AND source_size > 0
  UNION ALL
  SELECT k + 1, source, lam + greatest(-1, least(1, CASE WHEN d > 0 THEN -(g + c * step) / d ELSE -1 END)), theta + step FROM
    (SELECT *, greatest(-1, least(1, -(sum(q) OVER () + (SELECT q FROM fixed) + {MIX_SLACK} * n * theta - sum(CASE WHEN d > 0 THEN c * g / d ELSE 0 END) OVER ()) / (sum(e) OVER () + {MIX_SLACK} * n - sum(CASE WHEN d > 0 THEN c * c / d ELSE 0 END) OVER ()))) AS step FROM
      (SELECT k, source, lam, theta, n, sum(t) - any_value(target) AS g, sum(h) AS d, sum(h * z) AS c, sum(h * z * z) AS e, sum(t * z) AS q FROM
        (SELECT k, steps.source, lam, theta, n, target, z, m * least(3.0, exp(lam + theta * z)) AS t, CASE WHEN exp(lam + theta * z) < 3.0 THEN m * exp(lam + theta * z) ELSE 0 END AS h FROM steps JOIN off ON steps.source IS NOT DISTINCT FROM off.source, mean WHERE k < 20)
      GROUP BY k, source, lam, theta, n))),
solved AS (SELECT source, lam, theta FROM steps WHERE k = 20),
r AS (SELECT d.*, source_size, target, CASE WHEN size = 0 THEN 0 WHEN f THEN 3.0 ELSE coalesce(round(least(3.0, exp(lam + theta * (length(bin(size)) - b))), 9), 0) END AS rate FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source LEFT JOIN solved ON d.source IS NOT DISTINCT FROM solved.source, mean),
p AS (SELECT *, round(sum(size * (rate - floor(rate))) OVER (PARTITION BY source), 3) AS extra, coalesce(sum(size) OVER (PARTITION BY source ORDER BY ('0x' || substring(place, 1, 12))::BIGINT / 281474976710656 - (rate - floor(rate)), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM r)
SELECT doc_id, size, source_size, target, ((floor(rate) + CASE WHEN rate > floor(rate) AND ahead + size / 2 < extra THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM p
"""

OP8 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, unnest({_windows('least(5, len(w))')}) AS s FROM w WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM pairs JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON reach.r = links.a),
comp AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM comp LEFT JOIN n USING (doc_id)
"""

_SHARES = {
    "symbol_share": "n_symbols / greatest(word_chars, 1)",
    "capital_share": "n_capitals / greatest(word_chars, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "word_length": "word_chars / greatest(n_words, 1)",
}
_LONG = " UNION ALL ".join(f"SELECT doc_id, lang, source, '{m}' AS measure, {sql} AS value, {SLACK[m]}::DOUBLE AS slack FROM base" for m, sql in _SHARES.items())


def _limits(by: str) -> str:
    keys = f"{by}, measure" if by else "measure"
    return (
        f"SELECT {keys}, min(v) FILTER (upto >= 0.75 * docs) + greatest({FENCE} * (min(v) FILTER (upto >= 0.75 * docs) - min(v) FILTER (upto >= 0.25 * docs)), any_value(slack)) AS lim, max(docs) AS docs FROM "
        f"(SELECT {keys}, slack, coalesce(pow({GAMMA}, bucket) * (2 / (1 + {GAMMA}::DOUBLE)), 0) AS v, sum(n) OVER (PARTITION BY {keys} ORDER BY bucket NULLS FIRST ROWS UNBOUNDED PRECEDING) AS upto, sum(n) OVER (PARTITION BY {keys}) AS docs FROM (SELECT {keys}, slack, bucket, sum(n) AS n FROM sketch GROUP BY ALL)) GROUP BY {keys}"
    )


OP9 = rf"""
WITH dw AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, unnest(range(0, len(w) - 7)) AS pos, unnest({_windows('8')}) AS win FROM dw WHERE len(w) >= 8),
twice AS (SELECT doc_id, pos FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, win) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(pos, pos + 8)) AS p FROM twice) GROUP BY doc_id),
ln AS (SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM dw),
base AS (SELECT ln.doc_id, lang, source, len(w)::BIGINT AS n_words, len(array_to_string(w, ''))::BIGINT AS word_chars, (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_capitals, len(lines) AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words FROM ln LEFT JOIN rep USING (doc_id)),
long AS ({_LONG}),
sketch AS (SELECT lang, source, measure, slack, CASE WHEN value > 0 THEN ceil(ln(value) / ln({GAMMA}::DOUBLE))::INT END AS bucket, count(*) AS n FROM long GROUP BY ALL),
own AS ({_limits('lang, source')}), whole AS ({_limits('')}),
lim AS (SELECT own.lang, own.source, measure, (own.docs::DOUBLE * own.lim + {PRIOR_DOCS}::DOUBLE * whole.lim) / (own.docs::DOUBLE + {PRIOR_DOCS}::DOUBLE) AS lim FROM own JOIN whole USING (measure)),
bad AS (SELECT DISTINCT long.doc_id FROM long JOIN lim ON lim.measure = long.measure AND lim.lang IS NOT DISTINCT FROM long.lang AND lim.source IS NOT DISTINCT FROM long.source WHERE value > lim.lim),
out AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM bad) AS kept FROM out
"""

_KEY = rf"translate(regexp_replace(x, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), '{UPPER}', '{LOWER}')"
OP10 = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(range(len(lines))) AS pos, unnest(lines) AS x FROM d), k AS (SELECT *, {_KEY} AS key FROM l),
many AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
f AS (SELECT *, key IN (SELECT key FROM many) AS gone FROM k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(x, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM f GROUP BY doc_id
"""
