"""Queries of this package and, where SQL can express them over whole tables, the SQL that checks them."""

from . import canonical, encodings, languages, leaks, neardup, packing, pieces, pii, sharedspans, splits

QUERIES = {
    f.__name__: f
    for f in (
        splits.p1_found,
        splits.p1_splits,
        pieces.p2_found,
        pieces.p2_pieces,
        languages.p3_found,
        languages.p3_segments,
        neardup.p4_found,
        neardup.p4_groups,
        canonical.p5_found,
        canonical.p5_mapped,
        pii.p6_found,
        pii.p6_redacted,
        encodings.p7_found,
        encodings.p7_restored,
        packing.p8_found,
        packing.p8_containers,
        leaks.p9_found,
        leaks.p9_leaks,
        sharedspans.p10_found,
        sharedspans.p10_shared,
    )
}

#: Word in RE2 syntax.
_W = r"[\p{L}\p{N}]+"

SQL = {
    "p1_found": """
        WITH RECURSIVE r AS (SELECT DISTINCT lower(trim(record_id)) AS r, author_id AS a FROM documents WHERE trim(record_id) <> '' AND author_id IS NOT NULL),
        e AS (SELECT DISTINCT x.a AS a, y.a AS b FROM r x JOIN r y ON x.r = y.r),
        t(a, b) AS (SELECT a, b FROM e UNION SELECT t.a, e.b FROM t JOIN e ON t.b = e.a),
        g AS (SELECT a, min(b) AS g FROM t GROUP BY a),
        n AS (SELECT g, count(DISTINCT r) AS n FROM r JOIN g USING (a) GROUP BY g)
        SELECT DISTINCT feature_id, g AS group_author FROM chunk_records
        JOIN r ON r.r = lower(trim(split_part(feature_id, '::chunk-', 1))) JOIN g USING (a) JOIN n USING (g) WHERE n >= 2
    """,
    "p4_found": rf"""
        WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '{_W}') AS w FROM documents WHERE text IS NOT NULL),
        s AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 2], ' ') AS s FROM w, unnest(generate_series(1, len(w) - 2)) AS g(k) WHERE len(w) >= 40),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        p AS (SELECT x.doc_id AS doc_a, y.doc_id AS doc_b, count(*) AS c FROM s x JOIN s y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2)
        SELECT doc_a, doc_b FROM p JOIN n a ON a.doc_id = doc_a JOIN n b ON b.doc_id = doc_b WHERE c >= 0.7 * (a.n + b.n - c)
    """,
    "p2_found": """
        SELECT 'document' AS item_kind, cast(doc_id AS varchar) AS item_key FROM documents WHERE length(text) > 6000
        UNION SELECT 'chunk', feature_id FROM chunk_records WHERE length(text) > 1200 AND feature_id IS NOT NULL
    """,
    "p8_found": rf"""
        SELECT DISTINCT doc_id FROM documents
        WHERE len(regexp_extract_all(text, '{_W}|[^\p{{L}}\p{{N}}\s\x0b\x1c-\x1f\x{{85}}\x{{a0}}\x{{2028}}\x{{2029}}\x{{3000}}]')) > 1024
    """,
    "p9_found": rf"""
        WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '{_W}') AS w FROM documents WHERE text IS NOT NULL),
        i AS (SELECT item_id, regexp_extract_all(lower(text), '{_W}') AS w FROM eval_items WHERE text IS NOT NULL),
        dw AS (SELECT doc_id, array_to_string(w[k:k + 19], ' ') AS s FROM d, unnest(generate_series(1, len(w) - 19)) AS g(k)),
        iw AS (SELECT item_id, array_to_string(w[k:k + 19], ' ') AS s FROM i, unnest(generate_series(1, len(w) - 19)) AS g(k))
        SELECT DISTINCT item_id, doc_id FROM iw JOIN dw USING (s)
    """,
    "p10_found": """
        WITH p AS (SELECT doc_id, k - 1 AS s, hash(substr(text, k, 300)) AS h FROM documents, unnest(generate_series(1, length(text) - 299)) AS g(k)),
        m AS (SELECT doc_id, s FROM p WHERE h IN (SELECT h FROM p GROUP BY h HAVING count(DISTINCT doc_id) > 1)),
        r AS (SELECT doc_id, s, sum(b) OVER (PARTITION BY doc_id ORDER BY s) AS r FROM (
            SELECT doc_id, s, CASE WHEN s - lag(s) OVER (PARTITION BY doc_id ORDER BY s) <= 300 THEN 0 ELSE 1 END AS b FROM m))
        SELECT doc_id, min(s) AS span_start, max(s) + 300 AS span_end FROM r GROUP BY doc_id, r
    """,
}

#: Pairs of near documents, as p4_found has them, for the groups over them.
_PAIRS = SQL["p4_found"].strip()
SQL["p4_groups"] = rf"""
    WITH RECURSIVE pairs AS ({_PAIRS}),
    t AS (SELECT doc_id, regexp_extract_all(lower(text), '{_W}') AS w FROM documents WHERE text IS NOT NULL),
    k AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY w) AS class_id FROM t WHERE len(w) >= 40),
    e AS (SELECT DISTINCT a.class_id AS a, b.class_id AS b FROM pairs JOIN k a ON a.doc_id = doc_a JOIN k b ON b.doc_id = doc_b WHERE a.class_id <> b.class_id),
    u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
    r(a, b) AS (SELECT a, b FROM u UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a),
    g AS (SELECT a, least(a, min(b)) AS g FROM r GROUP BY a), n AS (SELECT a, count(*) AS n FROM u GROUP BY a)
    SELECT doc_id, coalesce(g.g, class_id) AS group_id, class_id, coalesce(n.n, 0) AS links FROM k LEFT JOIN g ON g.a = class_id LEFT JOIN n ON n.a = class_id
"""
SQL["p9_leaks"] = rf"""
    WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '{_W}') AS w FROM documents WHERE text IS NOT NULL),
    i AS (SELECT item_id, regexp_extract_all(lower(text), '{_W}') AS w FROM eval_items WHERE text IS NOT NULL),
    dw AS (SELECT doc_id, k AS j, array_to_string(w[k:k + 19], ' ') AS s FROM d, unnest(generate_series(1, len(w) - 19)) AS g(k)),
    iw AS (SELECT item_id, k AS i, array_to_string(w[k:k + 19], ' ') AS s FROM i, unnest(generate_series(1, len(w) - 19)) AS g(k)),
    m AS (SELECT item_id, doc_id, i, j, s, i - row_number() OVER (PARTITION BY item_id, doc_id, j - i ORDER BY i) AS island FROM iw JOIN dw USING (s)),
    l AS (SELECT item_id, doc_id, max(n) + 19 AS longest_run FROM (SELECT item_id, doc_id, count(*) AS n FROM m GROUP BY item_id, doc_id, j - i, island) GROUP BY 1, 2)
    SELECT item_id, doc_id, count(DISTINCT s) AS shared_windows, any_value(item_windows) AS item_windows, any_value(longest_run) AS longest_run
    FROM m JOIN l USING (item_id, doc_id) JOIN (SELECT item_id, count(DISTINCT s) AS item_windows FROM iw GROUP BY 1) USING (item_id) GROUP BY 1, 2
"""
SQL["p10_shared"] = f"""
    WITH f AS ({SQL["p10_found"]}), s AS (SELECT doc_id, sum(span_end - span_start)::bigint AS n FROM f GROUP BY 1)
    SELECT d.doc_id, coalesce(length(text), 0)::bigint AS n_chars, coalesce(s.n, 0) AS shared_chars, coalesce(round(s.n / length(text), 6), 0.0) AS share FROM documents d LEFT JOIN s USING (doc_id)
"""
