"""SQL for DuckDB with the rows of the registered queries, where SQL can say them."""

from __future__ import annotations

SQL: dict[str, str] = {}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL["op2_url_filters"] = f"""
WITH rules(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
                               ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
rest AS (SELECT page_id, row_number() OVER () AS rid,
                CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (SELECT page_id, rid, {_LOWER.format("regexp_extract(r, '^[^/?#]*')")} AS host,
                 substr(regexp_extract(r, '^[^?#]*'), length(regexp_extract(r, '^[^/?#]*')) + 1) AS path FROM rest),
fits AS (SELECT rid, max({{'n': length(h) + length(p), 'rule': h || p, 'v': v}}) AS b FROM parts
         JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY rid)
SELECT page_id, host, path, b.rule AS rule, coalesce(b.v, 'allow') AS verdict FROM parts LEFT JOIN fits USING (rid)
"""

SQL["op3_ngram_join"] = f"""
WITH RECURSIVE texts AS (SELECT doc_id, row_number() OVER () AS rid, {_WORDS.replace("coalesce(text, '')", _LOWER.format("coalesce(text, '')"))} AS w FROM documents),
grams AS (SELECT DISTINCT rid, array_to_string(w[i:i + 3], ' ') AS g
          FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM texts WHERE len(w) > 0)),
sizes AS (SELECT rid, count(*) AS n FROM grams GROUP BY rid),
shared AS (SELECT a.rid AS x, b.rid AS y, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.rid < b.rid GROUP BY ALL),
links AS (SELECT x, y FROM shared JOIN sizes s ON s.rid = x JOIN sizes t ON t.rid = y WHERE 100 * c >= 85 * (s.n + t.n - c)),
pairs AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (SELECT rid AS a, rid AS b FROM texts UNION SELECT a, y FROM reach JOIN pairs ON b = x)
SELECT t.doc_id, coalesce(s.n, 0) AS n_shingles, (SELECT min(o.doc_id) FROM reach JOIN texts o ON o.rid = b WHERE a = t.rid) AS component_id
FROM texts t LEFT JOIN sizes s USING (rid)
"""

SQL["op6_substring_dedup"] = f"""
WITH texts AS (SELECT doc_id, row_number() OVER () AS rid, {_WORDS} AS w FROM documents),
windows AS (SELECT rid, i, array_to_string(w[i:i + 34], ' ') AS s
            FROM (SELECT rid, w, unnest(range(1, len(w) - 33)) AS i FROM texts WHERE len(w) >= 35)),
gone AS (SELECT DISTINCT rid, unnest(range(i, i + 35)) AS pos
         FROM (SELECT rid, i, count(*) OVER (PARTITION BY s) AS c FROM windows) WHERE c > 1),
placed AS (SELECT rid, unnest(range(1, len(w) + 1)) AS pos, unnest(w) AS word FROM texts),
kept AS (SELECT rid, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS s FROM placed ANTI JOIN gone USING (rid, pos) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM texts LEFT JOIN kept USING (rid)
"""

SQL["op9_suffix_dedup"] = """
WITH texts AS (SELECT doc_id, row_number() OVER () AS rid, hex(encode(coalesce(text, ''))) AS h FROM documents),
windows AS (SELECT doc_id, rid, i, md5(substr(h, 2 * i + 1, 200)) AS s
            FROM (SELECT doc_id, rid, h, unnest(range(0, len(h) // 2 - 99)) AS i FROM texts WHERE len(h) >= 200)),
later AS (SELECT rid, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY s) AS d, min(i) OVER (PARTITION BY s, rid) AS j FROM windows) WHERE doc_id > d OR i > j),
runs AS (SELECT rid, min(i) AS a, max(i) + 100 AS b
         FROM (SELECT rid, i, sum(new) OVER (PARTITION BY rid ORDER BY i) AS run
               FROM (SELECT rid, i, CASE WHEN i > lag(i) OVER (PARTITION BY rid ORDER BY i) + 100 THEN 1 ELSE 0 END AS new FROM later))
         GROUP BY rid, run),
gaps AS (SELECT rid, b, coalesce(lead(a) OVER (PARTITION BY rid ORDER BY a), 1000000000) AS c FROM runs
         UNION ALL SELECT rid, 0, coalesce(min(a), 1000000000) FROM texts LEFT JOIN runs USING (rid) GROUP BY rid),
kept AS (SELECT rid, string_agg(substr(h, 2 * b + 1, 2 * (least(c, len(h) // 2) - b)), '' ORDER BY b) AS k
         FROM gaps JOIN texts USING (rid) WHERE b < least(c, len(h) // 2) GROUP BY rid),
spans AS (SELECT rid, count(*) AS n FROM runs GROUP BY rid)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST((len(h) - coalesce(len(k), 0)) // 2 AS BIGINT) AS n_removed,
       coalesce(n, 0) AS n_spans, sha256(unhex(coalesce(k, ''))) AS kept_sha256
FROM texts LEFT JOIN kept USING (rid) LEFT JOIN spans USING (rid)
"""

# Rates in thousandths, with their slack; the sketch keeps the first seven bits of a rate.
_RATES = [("symbols", "n_symbols", "n_words", 250), ("marks", "n_marks", "n_words", 300), ("word_length", "word_chars", "n_words", 3000),
          ("dup_lines", "n_dup_lines", "n_lines", 300)]
_MILLI = "\n  UNION ALL ".join(
    f"SELECT rid, lang, source, '{r}' AS rate, {slack} AS slack, CASE WHEN {d} > 0 THEN 1000 * {n} // {d} ELSE 0 END AS v FROM counts" for r, n, d, slack in _RATES)

SQL["op10_quality_rules"] = rf"""
WITH texts AS (SELECT doc_id, row_number() OVER () AS rid, lang, source, coalesce(text, '') AS t, {_WORDS} AS w,
                      list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
windows AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS c
            FROM (SELECT rid, i, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM texts WHERE len(w) >= 5))),
repeats AS (SELECT rid, count(DISTINCT pos) AS n FROM (SELECT rid, unnest(range(i, i + 5)) AS pos FROM windows WHERE c > 1) GROUP BY rid),
counts AS (SELECT rid, doc_id, lang, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
                  length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols, length(t) - length(translate(t, '!?', '')) AS n_marks,
                  len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
           FROM texts LEFT JOIN repeats USING (rid)),
rates AS ({_MILLI}),
sketch AS (SELECT lang, source, rate, slack, (v >> greatest(length(bin(v)) - 7, 0)) << greatest(length(bin(v)) - 7, 0) AS bucket, count(*) AS n
           FROM rates JOIN counts USING (rid, lang, source) WHERE n_words > 0 GROUP BY ALL),
ranked AS (SELECT *, sum(n) OVER (PARTITION BY lang, source, rate ORDER BY bucket) AS pos, sum(n) OVER (PARTITION BY lang, source, rate) AS total FROM sketch),
fences AS (SELECT lang, source, rate, 4 * min(bucket) FILTER (4 * pos >= 3 * total) - 3 * min(bucket) FILTER (4 * pos >= total) + any_value(slack) AS fence
           FROM ranked GROUP BY lang, source, rate),
passed AS (SELECT r.rid, bool_and(v <= fence) AS ok FROM rates r JOIN fences f
           ON r.lang IS NOT DISTINCT FROM f.lang AND r.source IS NOT DISTINCT FROM f.source AND r.rate = f.rate GROUP BY r.rid)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND coalesce(ok, FALSE) AS kept
FROM counts LEFT JOIN passed USING (rid)
"""

SQL["op11_warc"] = """
WITH payloads AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages),
last AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS top FROM payloads)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN n >= 1000 AND page_id IS DISTINCT FROM top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id IS DISTINCT FROM top THEN top END AS refers_to FROM last
"""

_TERMS = "regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

SQL["op12_ranked_search"] = f"""
WITH texts AS (SELECT doc_id, row_number() OVER () AS rid, {_TERMS} AS t FROM documents),
facts AS (SELECT count(*) AS n_docs, CAST(sum(len(t)) AS BIGINT) AS total FROM texts WHERE len(t) > 0),
items AS (SELECT item, item_id, unnest(list_distinct(t)) AS term
          FROM (SELECT item_id, row_number() OVER () AS item, {_TERMS} AS t FROM (SELECT DISTINCT item_id, text FROM benchmark))),
found AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(t) AS term FROM texts) WHERE term IN (SELECT term FROM items) GROUP BY ALL),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1))) AS BIGINT) AS w
            FROM (SELECT term, count(*) AS df FROM found GROUP BY term), facts),
sizes AS (SELECT rid, doc_id, 100 - 50 + (50 * len(t) * n_docs) // total AS m FROM texts, facts WHERE len(t) > 0),
scores AS (SELECT item, item_id, rid, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
           FROM items JOIN found USING (term) JOIN weights USING (term) JOIN sizes USING (rid) GROUP BY ALL)
SELECT item_id, rank, doc_id, score
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scores WHERE score > 0) WHERE rank <= 50
"""
