"""The queries of this subpackage that SQL can express, in DuckDB's SQL, by plain methods over the same tables."""

from . import license_scan, quality_rules

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NEAR_DEDUP = f"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
places AS (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM words WHERE len(w) > 0),
sets AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s, len(w) < 5 AS short FROM places),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY 1),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sets a JOIN sets b ON a.s = b.s AND a.short = b.short AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
comps AS (SELECT a, min(least(a, b)) AS c FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(z.n, 0) AS n_shingles, coalesce(c, d.doc_id) AS component_id, coalesce(c, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN sizes z USING (doc_id) LEFT JOIN comps ON comps.a = d.doc_id
"""

_WORDS = "regexp_extract_all({}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

DECONTAMINATE = f"""
WITH items AS (SELECT item_id, {_WORDS.format(_LOWER)} AS w FROM benchmark),
spots AS (SELECT item_id, w, least(8, len(w)) AS size, unnest(generate_series(1, len(w) - least(8, len(w)) + 1)) AS i FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS x FROM spots),
texts AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS w FROM documents),
spans AS (SELECT doc_id, w, size, unnest(generate_series(1, len(w) - size + 1)) AS i FROM texts, (SELECT DISTINCT size FROM windows) WHERE len(w) >= size),
found AS (SELECT a.doc_id, a.i, a.size, n.item_id FROM (SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS x FROM spans) a JOIN windows n ON n.size = a.size AND n.x = a.x),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + size - 1)) AS p FROM found) GROUP BY 1),
held AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS names FROM found GROUP BY 1)
SELECT t.doc_id, CAST(len(t.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM texts t LEFT JOIN hits USING (doc_id) LEFT JOIN held USING (doc_id)
"""

URL_FILTER = """
WITH rest AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
cut AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
rules AS (SELECT * FROM (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) t(h, p, v)),
met AS (SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS verdict FROM cut JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY 1)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM cut LEFT JOIN met USING (page_id)
"""



def _licenses() -> str:
    flat = sorted((name, license_scan.bigrams_of(t)) for name, texts in license_scan.TEMPLATES.items() for t in texts)
    texts = lambda grams: f"CAST([{', '.join(repr(b) for b in grams)}] AS VARCHAR[])"  # noqa: E731
    rows = ", ".join(f"({k}, '{name}', {texts(grams)}, {texts(license_scan.telling(grams))})" for k, (name, grams) in enumerate(flat))
    fuller = ", ".join(f"('{more}', '{less}')" for more, less in license_scan.FULLER.items())
    return rf"""
WITH templates AS (SELECT * FROM (VALUES {rows}) t(k, name, g, telling)),
fuller AS (SELECT * FROM (VALUES {fuller}) t(more, less)),
lower AS (SELECT doc_id, {_LOWER} AS t FROM documents),
raw AS (SELECT doc_id, unnest(string_split(regexp_replace(t, '([.!?:;])[	

 ]+', '' || chr(10), 'g'), chr(10))) AS u FROM lower
    UNION ALL SELECT doc_id, unnest(string_split(t, chr(10))) FROM lower UNION ALL SELECT doc_id, unnest(regexp_split_to_array(t, '
[	

 ]*
')) FROM lower UNION ALL SELECT doc_id, t FROM lower),
units AS (SELECT DISTINCT doc_id, array_to_string(regexp_extract_all(u, '[a-z0-9]+'), ' ') AS x FROM raw),
few AS (SELECT doc_id, string_split(x, ' ') AS w FROM units WHERE length(x) - length(replace(x, ' ', '')) >= 1),
grams AS (SELECT doc_id, row_number() OVER () AS unit, list_distinct(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM few),
met AS (SELECT doc_id, unit, k, name, list_has_all(grams.g, telling) AS agrees, 2 * len(list_intersect(grams.g, templates.g)) / (len(grams.g) + len(templates.g)) AS dice FROM grams JOIN templates
    ON len(grams.g) BETWEEN ceil({license_scan.LEAST} / (2 - {license_scan.LEAST}) * len(templates.g) - 1e-9) AND floor((2 - {license_scan.LEAST}) / {license_scan.LEAST} * len(templates.g) + 1e-9)),
hits AS (SELECT * FROM met WHERE dice >= {license_scan.LEAST}),
top AS (SELECT doc_id, count(DISTINCT unit) AS n_units, max(dice) AS dice FROM hits GROUP BY 1),
best AS (SELECT doc_id, k, name, dice FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, unit ORDER BY dice DESC, k) AS n FROM hits WHERE agrees) WHERE n = 1),
held AS (SELECT DISTINCT doc_id, name FROM best b WHERE NOT EXISTS (SELECT 1 FROM best c JOIN fuller ON more = c.name AND less = b.name WHERE c.doc_id = b.doc_id)),
names AS (SELECT doc_id, string_agg(name, ',' ORDER BY name) AS licenses FROM held GROUP BY 1),
first AS (SELECT doc_id, name FROM (SELECT b.*, row_number() OVER (PARTITION BY b.doc_id ORDER BY dice DESC, k) AS n FROM best b JOIN held USING (doc_id, name)) WHERE n = 1)
SELECT d.doc_id, first.name AS license, top.dice, coalesce(n_units, 0) AS n_units, coalesce(licenses, '') AS licenses FROM documents d LEFT JOIN top USING (doc_id) LEFT JOIN names USING (doc_id) LEFT JOIN first USING (doc_id)
"""


def _rules() -> str:
    q = quality_rules
    langs, words = (", ".join(f"'{x}'" for x in xs) for xs in (q.LANGUAGES, q.WORDS))
    cut = lambda pattern: f"length(text) - length(regexp_replace(text, '{pattern}', '', 'g'))"  # noqa: E731
    return rf"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS text FROM documents),
t AS (SELECT doc_id, lang, text, regexp_extract_all(text, '[^ 	-
]+') AS w FROM d),
spots AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS x FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 4)) AS i FROM t WHERE len(w) >= 5)),
again AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(generate_series(i, i + 4)) AS p FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS c FROM spots) WHERE c > 1) GROUP BY 1),
lines AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^ 	-
]') GROUP BY 1),
base AS (SELECT t.doc_id, lang, text, w, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST({cut('[#*$%&|<>]')} AS BIGINT) AS n_symbols, coalesce(lines.n, 0) AS n_dup_lines, coalesce(again.n, 0) AS n_repeat_words
    FROM t LEFT JOIN lines USING (doc_id) LEFT JOIN again USING (doc_id)),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base),
classes AS (SELECT doc_id, lang, base_failed, n_words, unnest([{cut(r'\p{Ll}')}, {cut(r'\p{Lu}')}, {cut(r'\p{Nd}')}, length(text) - word_chars, length(text) - ({cut(r'[\p{Ll}\p{Lu}\p{Nd}]')}) - (length(text) - word_chars)]) AS c, CAST(unnest([1, 2, 3, 4, 5]) AS VARCHAR) AS bin, greatest(length(text), 1) AS total FROM judged),
spoken AS (SELECT doc_id, rtrim(lower(unnest(w)), '.,;:!?') AS bin FROM judged),
counted AS (SELECT doc_id, bin, count(*) AS c FROM spoken WHERE bin IN ({words}) GROUP BY 1, 2),
grid AS (SELECT doc_id, lang, base_failed, n_words, bin, coalesce(c, 0) AS c FROM (SELECT doc_id, lang, base_failed, n_words, unnest([{words}]) AS bin FROM judged) LEFT JOIN counted USING (doc_id, bin)),
rest AS (SELECT doc_id, any_value(lang) AS lang, any_value(base_failed) AS base_failed, any_value(n_words) AS n_words, ' ' AS bin, greatest(any_value(n_words) - sum(c), 0) AS c FROM grid GROUP BY 1),
hist AS (SELECT 'c' AS kind, doc_id, lang, base_failed, n_words, bin, c, total FROM classes UNION ALL SELECT 'w', doc_id, lang, base_failed, n_words, bin, c, greatest(n_words, 1) FROM grid UNION ALL SELECT 'w', doc_id, lang, base_failed, n_words, bin, c, greatest(n_words, 1) FROM rest),
sums AS (SELECT kind, lang AS ref, bin, sum(c) AS c FROM hist WHERE lang IN ({langs}) AND NOT base_failed AND n_words >= {q.MIN_WORDS} GROUP BY 1, 2, 3),
refs AS (SELECT kind, ref, bin, c / greatest(sum(c) OVER (PARTITION BY kind, ref), 1) AS q FROM sums),
far AS (SELECT kind, doc_id, lang, ref, sqrt(greatest(0, sum(((CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END) + (CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END)) / 2))) AS x FROM (SELECT kind, doc_id, lang, bin, c / total AS p FROM hist) JOIN refs USING (kind, bin) GROUP BY 1, 2, 3, 4),
own AS (SELECT kind, doc_id, coalesce(max(x) FILTER (ref = lang), least(min(x), 1.0)) AS x FROM far GROUP BY 1, 2),
placed AS (SELECT j.*, coalesce(a.x, 0) AS cd, coalesce(b.x, 0) AS wd, coalesce(j.lang IN (SELECT ref FROM refs), false) AS known FROM judged j LEFT JOIN own a ON a.kind = 'c' AND a.doc_id = j.doc_id LEFT JOIN own b ON b.kind = 'w' AND b.doc_id = j.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(cd, 6) AS class_distance, round(wd, 6) AS word_distance,
    NOT base_failed AND NOT (known AND n_words >= {q.MIN_WORDS} AND (cd > {q.MAX_CLASS_DISTANCE} OR wd > {q.MAX_WORD_DISTANCE} OR (cd > {q.BOTH_CLASS} AND wd > {q.BOTH_WORD}))) AS kept FROM placed
"""


ORACLES = {"op2_license_scan": _licenses(), "op3_near_dedup": NEAR_DEDUP, "op4_decontaminate": DECONTAMINATE, "op5_url_filter": URL_FILTER, "op8_quality_rules": _rules()}
