"""DuckDB statements with the results that the queries must have."""

_EST = "ceil(length(content) / (4.0 - ((length(content) - length(translate(content, '{}();=<>[]', ''))) / length(content)) * 1.5))"

SQL = {
    "p3_found": f"""
        SELECT DISTINCT rec_table, rec_id FROM (
          SELECT 'sources' AS rec_table, id AS rec_id, content FROM sources
          UNION ALL SELECT 'chunks', id, content FROM chunks)
        WHERE length(content) > 0 AND {_EST} > 1000""",
    "p8_found": """
        WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents),
        e AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM eval_items),
        iw AS (SELECT item_id, least(13, len(w)) AS m, array_to_string(w[p : p + least(13, len(w)) - 1], ' ') AS t
          FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - least(13, len(w)), 0) + 2)) AS p FROM e WHERE len(w) > 0)),
        sizes AS (SELECT DISTINCT m FROM iw),
        dw AS (SELECT doc_id, m, array_to_string(w[p : p + m - 1], ' ') AS t
          FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM d, sizes WHERE len(w) >= m))
        SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (m, t)""",
    "p1_found": """
        WITH r AS (SELECT 'sources' AS rec_table, id AS key, content AS t FROM sources UNION ALL SELECT 'concepts', slug, compiled_truth FROM concepts),
        w AS (SELECT DISTINCT rec_table, key, unnest(regexp_extract_all(lower(t), '[a-z0-9]{3,}')) AS word FROM r WHERE t IS NOT NULL),
        n AS (SELECT rec_table, key, count(*) AS n FROM w GROUP BY ALL HAVING count(*) >= 20),
        p AS (SELECT a.rec_table, a.key AS key_a, b.key AS key_b, count(*) AS shared
          FROM w a JOIN w b ON a.rec_table = b.rec_table AND a.word = b.word AND a.key < b.key GROUP BY ALL)
        SELECT p.rec_table, key_a, key_b FROM p JOIN n x ON x.rec_table = p.rec_table AND x.key = key_a JOIN n y ON y.rec_table = p.rec_table AND y.key = key_b
        WHERE shared >= 0.7 * (x.n + y.n - shared) - 1e-9
          AND (p.rec_table = 'sources' OR 1 - levenshtein(key_a, key_b) / greatest(length(key_a), length(key_b)) >= 0.7 - 1e-9)""",
    "p1_groups": """
        WITH RECURSIVE r AS (SELECT 'sources' AS rec_table, id AS key, content AS t FROM sources UNION ALL SELECT 'concepts', slug, compiled_truth FROM concepts),
        w AS (SELECT DISTINCT rec_table, key, unnest(regexp_extract_all(lower(t), '[a-z0-9]{3,}')) AS word FROM r WHERE t IS NOT NULL),
        n AS (SELECT rec_table, key, count(*) AS n, string_agg(word, ' ' ORDER BY word) AS cls FROM w GROUP BY ALL HAVING count(*) >= 20),
        p AS (SELECT a.rec_table, a.key AS a, b.key AS b, count(*) AS shared FROM w a JOIN w b ON a.rec_table = b.rec_table AND a.word = b.word AND a.key < b.key GROUP BY ALL),
        l AS (SELECT p.rec_table, a, b, x.cls AS ca, y.cls AS cb FROM p JOIN n x ON x.rec_table = p.rec_table AND x.key = a JOIN n y ON y.rec_table = p.rec_table AND y.key = b
          WHERE shared >= 0.7 * (x.n + y.n - shared) - 1e-9 AND (p.rec_table = 'sources' OR 1 - levenshtein(a, b) / greatest(length(a), length(b)) >= 0.7 - 1e-9)),
        u AS (SELECT rec_table, a, b, ca, cb FROM l UNION ALL SELECT rec_table, b, a, cb, ca FROM l),
        c AS (SELECT DISTINCT rec_table, key AS a, key AS b FROM r UNION SELECT c.rec_table, c.a, u.b FROM c JOIN u ON u.rec_table = c.rec_table AND u.a = c.b),
        g AS (SELECT rec_table, a AS key, min(b) AS group_id FROM c GROUP BY ALL),
        d AS (SELECT rec_table, a AS key, CASE rec_table WHEN 'sources' THEN count(DISTINCT CASE WHEN ca <> cb THEN cb END) ELSE count(DISTINCT b) END AS links FROM u GROUP BY rec_table, a)
        SELECT g.rec_table, g.key, group_id, coalesce(links, 0) AS links FROM g LEFT JOIN d USING (rec_table, key)""",
    "p3_checks": f"""
        SELECT id AS source_id, true AS within, true AS slices, true AS starts, true AS ends FROM sources WHERE length(content) > 0 AND {_EST} > 1000""",
    "p4_lines": "SELECT id AS source_id, len(string_split(content, chr(10))) AS lines FROM sources WHERE content IS NOT NULL",
    "p7_checks": "SELECT count(*) AS documents, count(*) AS placed, 0 AS over, 0 AS clashes FROM documents WHERE text IS NOT NULL",
}
SQL["p8_covered"] = SQL["p8_found"]
