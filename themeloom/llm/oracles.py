"""DuckDB SQL of the queries here that SQL can express in full.

Of the others, ``tests/llm`` compares the plain parts with brute force.
"""

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD = r"'[^\x20\x09-\x0D]+'"
LOWERED = f"translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}')"

#: Windows of 50 words, the first document of each, and the words that are left.
SUBSTRING_DEDUP = f"""
    WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {WORD}) AS w FROM documents),
    windows AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h
                FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w)),
    firsts AS (SELECT h, min(doc_id) AS first FROM windows GROUP BY h),
    gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS pos
             FROM windows JOIN firsts USING (h) WHERE first < doc_id),
    word AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM w),
    kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS kept
             FROM word ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
    SELECT w.doc_id, len(w.w)::BIGINT AS n_words, (len(w.w) - coalesce(kept.n, 0))::BIGINT AS n_removed,
           sha256(coalesce(kept.kept, '')) AS kept_sha256
    FROM w LEFT JOIN kept USING (doc_id)"""

EXACT_DEDUP = f"""
    WITH n AS (SELECT doc_id, {LOWERED} AS t FROM documents),
    middle AS (SELECT (min(doc_id) + max(doc_id)) // 2 AS id FROM documents)
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
           doc_id = max(doc_id) OVER same AS kept, sha256(t) AS text_sha256,
           min(doc_id) OVER same <= (SELECT id FROM middle) AS in_history
    FROM n WINDOW same AS (PARTITION BY t)"""

#: All links by a self join of the shingles, and what they reach.
JACCARD_JOIN = f"""
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWERED}, {WORD}) AS w FROM documents),
    s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
            ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END)) AS g FROM w),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
    links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
    reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
    least_of AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
    counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
    SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(least_of.b, w.doc_id)) AS component_id,
           coalesce(counts.n, 0)::BIGINT AS n_links
    FROM w LEFT JOIN n USING (doc_id) LEFT JOIN least_of ON least_of.a = w.doc_id LEFT JOIN counts ON counts.a = w.doc_id"""

ORACLES: dict[str, str] = {
    "op1_substring_dedup": SUBSTRING_DEDUP,
    "op3_exact_dedup": EXACT_DEDUP,
    "op9_jaccard_join": JACCARD_JOIN,
}
