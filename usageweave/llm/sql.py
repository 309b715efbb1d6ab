"""The same results in DuckDB's SQL, where SQL can express them."""

from __future__ import annotations

from usageweave.llm.line_dedup import BLOCK_TAG, LineOptions
from usageweave.llm.quality import CLASSES, QualityOptions
from usageweave.llm.url_filter import LOWER, PATTERN_RULES, UPPER

ORACLES: dict[str, str] = {}

_REST = "CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END"
_URLS = f"""
SELECT page_id, url, html,
  translate(regexp_extract({_REST}, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
  regexp_extract({_REST}, '^[^/?#]*([^?#]*)', 1) AS path
FROM pages
"""


def _fits(name: str) -> str:
    host, slash, path = name.partition("/")
    return (
        f"((host = '{host}' OR ends_with(host, '.{host}'))"
        f" AND starts_with(path, '{slash}{path}'))"
    )


#: Longest first, with each rule's verdict.
_SITE = [
    ("www.example.com/en/", "allow"),
    ("example.com/en/", "block"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
    ("com/", "allow"),
]
_PATTERNS = sorted(PATTERN_RULES, key=lambda r: (-len(r.name), r.name))
_RULE = " ".join(f"WHEN {_fits(n)} THEN '{n}'" for n, _ in _SITE)
_PATTERN = " ".join(
    f"WHEN regexp_matches(host || path, '{r.pattern}') THEN '{r.name}'" for r in _PATTERNS
)
_BLOCKED = ", ".join(f"'{n}'" for n, action in _SITE if action == "block")
ORACLES["op6_url_filter"] = f"""
WITH u AS ({_URLS}),
r AS (SELECT *, CASE {_RULE} END AS rule FROM u),
p AS (SELECT *, CASE WHEN rule IS NULL THEN CASE {_PATTERN} END END AS pattern_rule FROM r)
SELECT page_id, host, path, rule, pattern_rule,
  CASE WHEN rule IN ({_BLOCKED}) OR pattern_rule IS NOT NULL THEN 'block' ELSE 'allow'
  END AS verdict
FROM p
"""

_L = LineOptions()
_WORD = "regexp_matches(line, '[^\\x20\\x09-\\x0D]')"
ORACLES["op7_line_dedup"] = f"""
WITH u AS (
  SELECT row_number() OVER () AS n, page_id, host,
    string_split(regexp_replace(html, '{BLOCK_TAG}', chr(10), 'g'), chr(10))
      AS lines
  FROM ({_URLS})),
l AS (
  SELECT n, page_id, host, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM u),
t AS (SELECT host, count(*) AS pages FROM u GROUP BY host),
b AS (
  SELECT host, line FROM l JOIN t USING (host) WHERE {_WORD}
  GROUP BY host, line, pages
  HAVING count(DISTINCT n) > 1 AND count(DISTINCT n) > {_L.max_share} * pages
    AND pages >= {_L.min_pages}),
k AS (
  SELECT l.*, b.line IS NOT NULL AS dropped FROM l LEFT JOIN b USING (host, line)),
g AS (
  SELECT n, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
    coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '') AS kept
  FROM k GROUP BY n)
SELECT page_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM u LEFT JOIN g USING (n)
"""

_K = 35
ORACLES["op8_substring_dedup"] = f"""
WITH d AS (
  SELECT row_number() OVER () AS n, doc_id,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (
  SELECT n, unnest(range(1, len(w) - {_K - 2})) AS i, w FROM d WHERE len(w) >= {_K}),
h AS (SELECT n, i, sha256(array_to_string(w[i:i + {_K - 1}], ' ')) AS h FROM s),
r AS (SELECT n, i FROM h WHERE h IN (SELECT h FROM h GROUP BY h HAVING count(*) > 1)),
c AS (SELECT DISTINCT n, unnest(range(i, i + {_K})) AS j FROM r),
x AS (SELECT n, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM d),
k AS (
  SELECT x.n, x.j, x.word, c.j IS NOT NULL AS gone FROM x LEFT JOIN c ON x.n = c.n AND x.j = c.j),
g AS (
  SELECT n, count(*) FILTER (gone) AS n_removed,
    coalesce(string_agg(word, ' ' ORDER BY j) FILTER (NOT gone), '') AS kept FROM k GROUP BY n)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN g USING (n)
"""

_Q = QualityOptions()
_N = len(CLASSES) + 1


def _count(pattern: str) -> str:
    quoted = pattern.replace("'", "''")
    return f"len(regexp_extract_all(t, '{quoted}'))"


def _term(x: str, y: str) -> str:
    """One side of the Jensen-Shannon divergence for one bin."""
    return f"CASE WHEN {x} > 0 THEN {x} * log2({x} / (({x} + {y}) / 2)) ELSE 0 END"


_BINS = ", ".join(_count(p) for p in CLASSES.values())


def _far(bins: str, refs: str, key: str) -> str:
    """Jensen-Shannon distances of histograms (key, lang, kind, bin, x, total) to those of
    their language (lang, kind, bin, q).
    """
    return f"""
  SELECT {key}, kind, sqrt(greatest(0, sum(({_term('p', 'q')} + {_term('q', 'p')}) / 2))) AS far
  FROM (
    SELECT {key}, kind, x / nullif(total, 0) AS p,
      q / nullif(sum(q) OVER (PARTITION BY {key}, kind), 0) AS q
    FROM {bins} JOIN {refs} USING (lang, kind, bin))
  GROUP BY {key}, kind
"""


_BOUND = f"({_Q.max_word_distance} + {_Q.word_noise} / sqrt(n_words))"
ORACLES["op10_quality_rules"] = f"""
WITH d AS (
  SELECT row_number() OVER () AS n, doc_id, coalesce('x' || lang, '') AS lang,
    coalesce(text, '') AS t FROM documents),
a AS (
  SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w, [{_BINS}] AS found FROM d),
c AS (
  SELECT *, len(w) AS n_words, list_append(found, length(t) - list_sum(found)) AS classes FROM a),
g AS (SELECT n, w, unnest(range(1, n_words - 1)) AS i FROM c WHERE n_words >= 3),
r AS (
  SELECT n, i, count(*) OVER (PARTITION BY n, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS m
  FROM g),
v AS (
  SELECT n, count(DISTINCT j) AS n_repeat_words
  FROM (SELECT n, unnest([i, i + 1, i + 2]) AS j FROM r WHERE m > 1) GROUP BY n),
l AS (
  SELECT n, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT n, unnest(string_split(t, chr(10))) AS line FROM d) WHERE {_WORD} GROUP BY n),
b AS (
  SELECT c.*, coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words,
    n_words < {_Q.min_words}
      OR 100 * coalesce(n_repeat_words, 0) > {_Q.max_repeat_percent} * n_words AS base_failed
  FROM c LEFT JOIN l USING (n) LEFT JOIN v USING (n)),
o AS (SELECT min(n) AS n FROM b WHERE NOT base_failed GROUP BY lang, t),
s AS (SELECT n, lang, lower(unnest(w)) AS word FROM c),
k AS (
  SELECT n, lang, word, count(*) AS x FROM s JOIN o USING (n)
  WHERE length(word) <= {_Q.short_word} GROUP BY n, lang, word),
f AS (
  SELECT lang, word, CAST(round(1000000000 * x / n_words) AS BIGINT) // 10000 AS step
  FROM k JOIN c USING (n, lang)),
texts AS (SELECT lang, count(*) AS texts FROM o JOIN c USING (n) GROUP BY lang),
h AS (
  SELECT lang, word, texts, list_reverse_sort(list(step)) AS steps FROM f JOIN texts USING (lang)
  GROUP BY lang, word, texts HAVING 2 * count(*) > texts),
top AS (
  SELECT lang, word, row_number() OVER (
    PARTITION BY lang ORDER BY steps[texts // 2 + 1] DESC, word) AS place FROM h
  WHERE steps[texts // 2 + 1] > 0
  QUALIFY place <= {_Q.common_words}),
own AS (SELECT n, place, count(*) AS x FROM s JOIN top USING (lang, word) GROUP BY n, place),
bins AS (
  SELECT n, lang, 'chars' AS kind, unnest(range(1, {_N + 1})) AS bin, unnest(classes) AS x,
    length(t) AS total FROM c
  UNION ALL
  SELECT c.n, lang, 'words', top.place, coalesce(x, 0), n_words
  FROM c JOIN top USING (lang) LEFT JOIN own ON own.n = c.n AND own.place = top.place
  UNION ALL
  SELECT n, lang, 'words', 0, n_words - coalesce(x, 0), n_words
  FROM c LEFT JOIN (SELECT n, sum(x) AS x FROM own GROUP BY n) USING (n)),
u AS (
  SELECT *, CAST(round(1000000000 * x / total) AS BIGINT) AS units FROM bins JOIN o USING (n)),
m AS (
  SELECT lang, kind, bin, quantile_disc(units // 10000, 0.5) * 10000 AS q FROM u
  GROUP BY lang, kind, bin),
odd AS (
  SELECT n, lang, bool_or(coalesce(far > CASE kind WHEN 'chars' THEN {_Q.max_class_distance}
    ELSE {_BOUND} END, FALSE)) AS odd
  FROM ({_far('u', 'm', 'n')}) JOIN c USING (n) GROUP BY n, lang),
ordinary AS (SELECT n FROM odd QUALIFY NOT odd OR bool_and(odd) OVER (PARTITION BY lang)),
ref AS (
  SELECT lang, kind, bin, sum(units) AS q FROM u JOIN ordinary USING (n) GROUP BY lang, kind, bin),
far AS ({_far('bins', 'ref', 'n')}),
z AS (
  SELECT b.*, length(t) - classes[3] AS word_chars, classes[5] AS n_symbols,
    x.far AS class_far, y.far AS word_far
  FROM b LEFT JOIN far x ON x.n = b.n AND x.kind = 'chars'
  LEFT JOIN far y ON y.n = b.n AND y.kind = 'words')
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
  CAST(n_symbols AS BIGINT) AS n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed
    AND NOT coalesce(class_far > {_Q.max_class_distance} AND word_chars >= {_Q.min_class_chars}, FALSE)
    AND NOT coalesce(word_far > {_BOUND} AND n_words >= {_Q.min_word_words}, FALSE)
    AS kept
FROM z
"""

_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+')"


def _near_duplicates(percent: int, more: str = "") -> str:
    """Components of texts whose sets of four-word shingles are alike."""
    return f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS n, doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT n, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT n, array_to_string(w[i:i + 3], ' ') AS x FROM i),
z AS (SELECT n, count(*) AS size FROM s GROUP BY n),
p AS (
  SELECT a.n AS a, b.n AS b, count(*) AS common FROM s a JOIN s b ON a.x = b.x AND a.n < b.n
  GROUP BY a.n, b.n),
e AS (
  SELECT a, b FROM p JOIN z y ON y.n = a JOIN z v ON v.n = b
  WHERE 100 * common >= {percent} * (y.size + v.size - common)),
t AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (
  SELECT n, n AS m FROM d
  UNION SELECT r.n, t.b FROM r JOIN t ON r.m = t.a),
c AS (SELECT r.n, min(d.doc_id) AS component_id FROM r JOIN d ON d.n = r.m GROUP BY r.n)
SELECT doc_id, coalesce(size, 0) AS n_shingles, component_id{more}
FROM d JOIN c USING (n) LEFT JOIN z USING (n)
"""


ORACLES["op3_ngram_join"] = _near_duplicates(85)
ORACLES["op12_minhash"] = _near_duplicates(80, ", doc_id = component_id AS kept")

_CUT = "[.,;:!?\\x0A-\\x0D]"
ORACLES["op13_phrases"] = f"""
WITH t AS (
  SELECT coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS text
  FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(text, '{_CUT}')) AS piece FROM t),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS words FROM p),
g AS (
  SELECT lang, words, size, unnest(range(1, len(words) - size + 2)) AS i
  FROM w, (SELECT unnest([1, 2, 3, 4]) AS size) s
  WHERE len(words) >= size),
f AS (
  SELECT lang, size, words[i : i + size - 1] AS phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM f WHERE size = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE size >= 2 AND f >= 30),
x AS (
  SELECT lang, words AS phrase, max(f) AS longest
  FROM (
    SELECT lang, f, unnest(list_distinct(list_transform(
      flatten(list_transform(range(2, size), lambda m: list_transform(
        range(1, size - m + 2), lambda i: [i, i + m - 1]))),
      lambda b: phrase[b[1] : b[2]]))) AS words
    FROM c)
  GROUP BY lang, words),
k AS (
  SELECT c.lang, c.phrase, c.size, c.f AS a, unnest(range(1, c.size)) AS k
  FROM c LEFT JOIN x ON c.lang = x.lang AND c.phrase = x.phrase
  WHERE x.longest IS NULL OR 100 * x.longest < 80 * c.f),
s AS (
  SELECT k.lang, k.phrase, k.a, k.k, l.f AS l, r.f AS r,
    (2000000::HUGEINT * k.a) // (l.f + r.f) AS score
  FROM k
  JOIN f l ON l.lang = k.lang AND l.phrase = k.phrase[1 : k.k]
  JOIN f r ON r.lang = k.lang AND r.phrase = k.phrase[k.k + 1 : k.size]),
b AS (
  SELECT * FROM s
  QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
o AS (
  SELECT lang, array_to_string(phrase, ' ') AS phrase, a, l, r, score FROM b),
q AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM o)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score
FROM q JOIN n USING (lang) WHERE rank <= 2000
"""
