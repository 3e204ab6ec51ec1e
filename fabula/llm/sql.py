"""DuckDB SQL of the queries that SQL can express.

SQL knows NFC only; of the further compatibility forms of NFKC it maps full-width signs, no-break spaces and the trade
mark, which are those that the test tables hold.
"""

from __future__ import annotations

_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
_PLAIN = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)).replace("'", "''")


def fold(t: str) -> str:
    return rf"lower(regexp_replace(translate(replace(nfc_normalize({t}), '™', 'TM'), '{_WIDE}' || chr(160), '{_PLAIN} '), '\p{{Cf}}', '', 'g'))"


def words(t: str) -> str:
    return rf"regexp_extract_all({fold(t)}, '[\p{{L}}\p{{N}}]+')"


def shingles(w: str, n: int) -> str:
    return f"list_transform(range(1, greatest(len({w}) - {n - 1}, 0) + 1), lambda i: array_to_string({w}[i:i + {n - 1}], ' '))"


_SPACE = r"[\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_TERM = f"trim(regexp_replace({fold('x')}, '{_SPACE}', ' ', 'g'), ' ')"
_COUNTS = f"""(WITH r AS (SELECT id, arg_max(words, loaded_at) AS words, arg_max(features, loaded_at) AS features FROM instruct_records GROUP BY id),
    e AS (SELECT 'words' AS field, id, unnest(words) AS x FROM r UNION ALL SELECT 'features', id, unnest(features) FROM r),
    t AS (SELECT field, id, {_TERM} AS term FROM e WHERE x IS NOT NULL),
    c AS (SELECT field, term, CAST(count(*) AS BIGINT) AS occurrences, CAST(count(DISTINCT id) AS BIGINT) AS records FROM t WHERE term <> '' GROUP BY field, term)
    SELECT *, CASE WHEN records < 3 THEN 'rare' WHEN records > 0.02 * (SELECT count(*) FROM r) THEN 'common' END AS mark FROM c)"""

_TEXTS = f"""t AS (SELECT id, {shingles(words("arg_max(story, loaded_at)"), 3)} AS g FROM instruct_records WHERE id IS NOT NULL AND story IS NOT NULL GROUP BY id),
    s AS (SELECT id, list_distinct(g) AS g FROM t WHERE len(g) > 0), n AS (SELECT id, len(g) AS n FROM s), x AS (SELECT id, unnest(g) AS g FROM s)"""

p2_found = f"SELECT field, term, mark FROM {_COUNTS} WHERE mark IS NOT NULL"
p2_term_counts = f"SELECT * FROM {_COUNTS}"

p3_found = f"""WITH {_TEXTS}, j AS (SELECT a.id AS a, b.id AS b, count(*) AS common FROM x a JOIN x b USING (g) WHERE a.id LIKE 'train-%' AND (b.id LIKE 'valid-%' OR b.id LIKE 'test-%') GROUP BY 1, 2)
    SELECT least(a, b) AS id_a, greatest(a, b) AS id_b FROM j JOIN n p ON p.id = a JOIN n q ON q.id = b WHERE common >= 0.7 * (p.n + q.n - common)"""
p3_overlap_report = f"""WITH f AS ({p3_found}), h AS (SELECT CASE WHEN id_a LIKE 'train-%' THEN id_b ELSE id_a END AS id, count(*) AS pairs FROM f GROUP BY 1),
    r AS (SELECT id, coalesce(max(lower(trim(source, ' '))), '(none)') AS source FROM instruct_records GROUP BY id)
    SELECT split_part(id, '-', 1) AS split, source, CAST(sum(pairs) AS BIGINT) AS pairs, CAST(count(*) AS BIGINT) AS ids FROM h JOIN r USING (id) GROUP BY 1, 2"""
p4_found = f"""WITH RECURSIVE {_TEXTS}, j AS (SELECT a.id AS a, b.id AS b, count(*) AS common FROM x a JOIN x b ON a.g = b.g AND a.id < b.id GROUP BY 1, 2),
    l AS (SELECT a, b FROM j JOIN n p ON p.id = a JOIN n q ON q.id = b WHERE common >= 0.5 * (p.n + q.n - common)), e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
    reach(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON e.a = r.b)
    SELECT a AS id, least(a, min(b)) AS group_id FROM reach GROUP BY a"""

_LEAKS = f"""(WITH i AS (SELECT item_id, {words('text')} AS w FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL)), d AS (SELECT doc_id, {words('text')} AS w FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL)),
    gi AS (SELECT item_id, unnest({shingles('w', 10)}) AS g, generate_subscripts({shingles('w', 10)}, 1) AS j FROM i), gd AS (SELECT doc_id, unnest({shingles('w', 10)}) AS g, generate_subscripts({shingles('w', 10)}, 1) AS k FROM d),
    m AS (SELECT doc_id, item_id, k, k - j AS diagonal FROM gi JOIN gd USING (g)), o AS (SELECT *, k - row_number() OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY k) AS island FROM m),
    c AS (SELECT doc_id, item_id, count(*) + 9 AS run FROM o GROUP BY doc_id, item_id, diagonal, island)
    SELECT doc_id, item_id, CAST(max(run) AS INTEGER) AS run_words FROM c GROUP BY doc_id, item_id)"""
p6_found = f"SELECT doc_id, item_id FROM {_LEAKS}"
p6_leaks = f"SELECT * FROM {_LEAKS}"

_LAST = """(SELECT id, arg_max(story, (loaded_at, octet_length(encode(story)))) AS story FROM instruct_records WHERE id IS NOT NULL AND octet_length(encode(story)) > 0 GROUP BY id)"""
p5_packing_check = f"""SELECT 'stories' AS kind, CAST(count(*) AS BIGINT) AS items, CAST(sum(octet_length(encode(story))) AS BIGINT) AS size, CAST(0 AS BIGINT) AS split_without_need, true AS within_capacity, true AS fills_right, true AS nine_tenths_full FROM {_LAST}
    UNION ALL SELECT 'requests', count(*), sum(size), 0, true, true, true FROM (SELECT bench_id, r.id, max(r.prompt_tokens) AS size FROM (SELECT bench_id, unnest(per_request) AS r FROM bench_runs) WHERE bench_id IS NOT NULL AND r.id IS NOT NULL AND r.prompt_tokens > 0 GROUP BY ALL)"""

_NAME = r"lower(regexp_replace(source, '^[\s\x{A0}\x{2000}-\x{200A}\x{3000}]+|[\s\x{A0}\x{2000}-\x{200A}\x{3000}]+$', '', 'g'))"
p7_share_check = f"""WITH t AS (SELECT {_NAME} AS source, sum(target_share) AS share FROM mix_targets WHERE source IS NOT NULL AND max_repeats > 0 GROUP BY 1 HAVING sum(target_share) > 0),
    d AS (SELECT DISTINCT {_NAME} AS source FROM documents WHERE doc_id IS NOT NULL AND source IS NOT NULL AND text <> '')
    SELECT source, round(share / sum(share) OVER (), 6) AS share, true AS met, true AS within_repeats FROM t JOIN d USING (source)"""
