"""DuckDB SQL with the same results as the registered queries.

Shared steps are named common table expressions; ``_q`` puts the ones a query
needs in front of it.
"""

from __future__ import annotations

from themeloom.operators.explore import BADGE_LABELS, SEVERITY_MARKS
from themeloom.operators.quotes import (
    CLUSTER_PROMPT, PROMPT_VERSION, SYNTHESIS_PROMPT, SYNTHESIS_SYSTEM, SYSTEM_PROMPT,
)
from themeloom.operators.sentiment import AMPLIFIERS, DAMPENERS, NEGATIONS
from themeloom.plans.tables import LEXICON, PHRASES


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _list(values) -> str:
    return "(" + ", ".join(_text(v) for v in values) + ")"


def _clean(column: str) -> str:
    return (
        "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(" + column
        + r", 'https?://\S+|www\.\S+', ' ', 'g'), '@[\p{L}\p{N}_]+', ' ', 'g'), "
        + r"""'[^\p{L}\p{N}_\s.,!?''"()\-:;/$%&+]', ' ', 'g'), '\s+', ' ', 'g'))"""
    )


TEXT_KEY = "sha1(lower(trim(text_clean)))"

CTES = {
    "tickets0": """
        SELECT conv_id, turn, text FROM conversations WHERE role = 'user'""",
    "fb": """
        SELECT d.source || ':' || d.doc_id AS id, d.doc_id AS seq, d.source AS source, d.text AS text,
               CAST(CASE l.quality WHEN 1 THEN 4 WHEN 0 THEN 2 END - l.toxic AS DOUBLE) AS rating,
               CAST(e.ts AS TIMESTAMP) AS ts, v.embedding AS embedding, coalesce(v.label, -1) AS cluster_id
        FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
        LEFT JOIN events e ON e.event_id = d.doc_id LEFT JOIN embeddings v ON v.vec_id = d.doc_id
        UNION ALL
        SELECT 'support_ticket:' || conv_id || '-' || turn, 1000000000000 + conv_id * 1000000 + turn, 'support_ticket', text,
               NULL, NULL, NULL, -1 FROM tickets0""",
    "cleaned": "SELECT *, " + _clean("text") + " AS text_clean FROM fb",
    "cl": "SELECT * FROM cleaned WHERE length(text_clean) >= 15",
    "flagged": "SELECT *, seq > min(seq) OVER (PARTITION BY " + TEXT_KEY + ") AS is_near_dup FROM cl",
    "lexicon": "SELECT * FROM (VALUES " + ", ".join(f"({_text(w)}, {v}::DOUBLE)" for w, v in LEXICON) + ") t(word, v)",
    "tok": r"""
        SELECT id, text_clean,
               list_filter(list_transform(string_split(text_clean, ' '),
                   lambda w: regexp_replace(w, '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g')), lambda w: w <> '') AS toks
        FROM cl""",
    "joined": """
        SELECT id, text_clean, string_split(trim(regexp_replace(regexp_replace(
                 regexp_replace(' ' || array_to_string(toks, '  ') || ' ', '(?i) (%s) ', ' <\\1> ', 'g'),
                 '<([^ <>]+)  ([^ <>]+)>', '\\1_\\2', 'g'), '<([^ <>]+)  ([^ <>]+)  ([^ <>]+)>', '\\1_\\2_\\3', 'g')), '  ') AS toks
        FROM tok""" % "|".join(x.replace(" ", "  ") for x, _ in sorted(PHRASES, key=lambda x: -len(x[0].split()))),
    "phrased": "SELECT * FROM lexicon UNION ALL SELECT * FROM (VALUES "
    + ", ".join(f"({_text(w.replace(' ', '_'))}, {v}::DOUBLE)" for w, v in PHRASES) + ") t(word, v)",
    "low": """
        SELECT id, toks, list_transform(toks, lambda w: replace(lower(w), '''', '')) AS low,
               least(length(text_clean) - length(replace(text_clean, '!', '')), 4) AS bangs,
               length(text_clean) - length(replace(text_clean, '?', '')) AS asks,
               len(list_filter(toks, lambda w: w = upper(w) AND w <> lower(w))) AS n_shout
        FROM tok""",
    "word": """
        SELECT id, low, toks, bangs, asks, (n_shout > 0 AND n_shout < len(toks)) AS mixed,
               coalesce(list_position(low, 'but'), 0) AS but_at,
               unnest(low) AS word, generate_subscripts(low, 1) AS i
        FROM low""",
    "hit": """
        SELECT w.*, x.v, CASE WHEN i > 1 THEN low[i - 1] END AS p1, CASE WHEN i > 2 THEN low[i - 2] END AS p2,
               CASE WHEN i > 3 THEN low[i - 3] END AS p3,
               mixed AND toks[i] = upper(toks[i]) AND toks[i] <> lower(toks[i]) AS loud
        FROM word w JOIN lexicon x ON x.word = w.word""",
    "val": "SELECT id, bangs, asks, (v + CASE WHEN loud THEN sign(v) * 0.733::DOUBLE ELSE 0::DOUBLE END"
    + "".join(
        f" + sign(v) * CASE WHEN {p} IN {_list(AMPLIFIERS)} THEN 0.293::DOUBLE WHEN {p} IN {_list(DAMPENERS)}"
        f" THEN -0.293::DOUBLE ELSE 0::DOUBLE END * {fade}::DOUBLE"
        for p, fade in (("p1", 1.0), ("p2", 0.95), ("p3", 0.9))
    )
    + ")"
    + "".join(f" * CASE WHEN {p} IN {_list(NEGATIONS)} THEN -0.74::DOUBLE ELSE 1::DOUBLE END" for p in ("p1", "p2", "p3"))
    + " * CASE WHEN p1 = 'least' AND coalesce(p2, '') NOT IN ('at', 'very') THEN -0.74::DOUBLE ELSE 1::DOUBLE END"
    + """ * CASE WHEN but_at > 0 AND i < but_at THEN 0.5::DOUBLE WHEN but_at > 0 AND i > but_at
           THEN 1.5::DOUBLE ELSE 1::DOUBLE END AS value FROM hit""",
    "mood": """
        SELECT id, round(greatest(-1, least(1, t / sqrt(t * t + 15))), 4) AS sentiment FROM (
          SELECT id, s + sign(s) * (b * 0.292::DOUBLE + CASE WHEN a > 3 THEN 0.96::DOUBLE WHEN a > 1 THEN a * 0.18::DOUBLE ELSE 0::DOUBLE END) AS t
          FROM (SELECT id, sum(value) AS s, max(bangs) AS b, max(asks) AS a FROM val GROUP BY id))""",
    "sig": """
        SELECT f.*, coalesce(m.sentiment, 0) AS sentiment,
               epoch_us(max(f.ts) OVER (PARTITION BY f.source)) / 86400000000.0 - epoch_us(f.ts) / 86400000000.0 AS age_days
        FROM flagged f LEFT JOIN mood m ON m.id = f.id""",
    "dims": """
        SELECT cluster_id, d, avg(x) AS x FROM (
          SELECT cluster_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS d
          FROM members WHERE embedding IS NOT NULL AND cluster_id <> -1)
        GROUP BY cluster_id, d""",
    "cent": """
        SELECT cluster_id, list(x / (n + 1e-12) ORDER BY d) AS c FROM (
          SELECT *, sqrt(sum(x * x) OVER (PARTITION BY cluster_id)) AS n FROM dims)
        GROUP BY cluster_id""",
    "cohere": """
        SELECT a.cluster_id, CASE WHEN n > 1 THEN (sq - squares) / (n * (n - 1.0)) ELSE 1 END AS cohesion
        FROM (SELECT cluster_id, count(*) AS n,
                     sum(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS squares
              FROM members WHERE embedding IS NOT NULL AND cluster_id <> -1 GROUP BY cluster_id) a
        JOIN (SELECT cluster_id, sum(t * t) AS sq FROM (
                SELECT cluster_id, d, sum(x) AS t FROM (
                  SELECT cluster_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS d
                  FROM members WHERE embedding IS NOT NULL AND cluster_id <> -1) GROUP BY cluster_id, d)
              GROUP BY cluster_id) b ON a.cluster_id = b.cluster_id""",
    "vec": "SELECT vec_id AS seq, embedding, label AS cluster_id FROM embeddings",
    "parts": """
        SELECT cluster_id, source, count(*) AS n FROM sig GROUP BY cluster_id, source""",
    "stats": """
        SELECT s.*, e.entropy, e.n_sources, e.src,
               (SELECT count(DISTINCT source) FROM sig) AS k,
               max(s.n_items) OVER () AS n_largest, s.cluster_id % 5 + 1 AS severity, c.cohesion
        FROM (SELECT cluster_id, count(*) AS n_items, count(*) FILTER (NOT is_near_dup) AS n_unique,
                     count(*) FILTER (sentiment < -0.05) AS n_neg, count(rating) AS n_rated,
                     sum((5 - rating) / 4) AS gloom, sum(abs(sentiment)) AS mood, count(age_days) AS n_aged,
                     sum(exp(-ln(2.0) / 90 * age_days)) AS fresh
              FROM sig WHERE cluster_id <> -1 GROUP BY cluster_id) s
        JOIN (SELECT cluster_id, count(*) AS n_sources,
                     -sum(n / t * ln(n / t)) AS entropy, string_agg(source || '=' || n, ';' ORDER BY source) AS src
              FROM (SELECT *, sum(n) OVER (PARTITION BY cluster_id)::DOUBLE AS t FROM parts) GROUP BY cluster_id) e
          ON e.cluster_id = s.cluster_id
        JOIN cohere c ON c.cluster_id = s.cluster_id""",
    "norms": """
        SELECT *, ln(1.0 + n_items) / ln(1.0 + greatest(n_largest, 2)) AS f_norm,
               CASE WHEN n_rated = 0 THEN 0.5 * (severity - 1) / 4.0 + 0.5 * mood / n_items
                    ELSE 0.5 * (severity - 1) / 4.0 + 0.3 * gloom / n_rated + 0.2 * mood / n_items END AS s_norm,
               CASE WHEN n_aged > 0 THEN fresh / n_aged ELSE 0.5 END AS r_norm,
               CASE WHEN k > 1 THEN entropy / ln(k::DOUBLE) ELSE 0 END AS d_norm
        FROM stats""",
    "scored": """
        SELECT *, round(cf + cs + cr + cd, 4) AS priority_score FROM (
          SELECT *, round(0.35::DOUBLE * f_norm, 4) AS cf, round(0.35::DOUBLE * s_norm, 4) AS cs,
                 round(0.15::DOUBLE * r_norm, 4) AS cr, round(0.15::DOUBLE * d_norm, 4) AS cd FROM norms)""",
    "conf": """
        SELECT *, CASE WHEN n_items < 5 THEN 'insufficient_evidence' WHEN n_items < 15 THEN 'low_sample' ELSE 'ok' END AS badge,
               round(greatest(0, (p + zz / n_items / 2 - h) / (1 + zz / n_items)), 4) AS wilson_low,
               round(least(1, (p + zz / n_items / 2 + h) / (1 + zz / n_items)), 4) AS wilson_high
        FROM (SELECT *, 1.96::DOUBLE * sqrt(p * (1 - p) / n_items + zz / (4.0 * n_items * n_items)) AS h
              FROM (SELECT *, n_neg / n_items::DOUBLE AS p, (1.96 * 1.96)::DOUBLE AS zz FROM scored))""",
    "ranked": "SELECT *, row_number() OVER (ORDER BY priority_score DESC, cluster_id) AS rank FROM conf",
    "placed": """
        SELECT s.*, list_dot_product(s.embedding::DOUBLE[], c.c) AS centroid_cos,
               CASE WHEN s.rating IS NOT NULL THEN 0.7::DOUBLE * (5 - s.rating) / 4 + 0.3::DOUBLE * greatest(0, -s.sentiment)
                    ELSE greatest(0, -s.sentiment) END AS prior
        FROM sig s LEFT JOIN cent c ON c.cluster_id = s.cluster_id""",
    "pool": """
        SELECT * FROM (SELECT *, count(*) FILTER (NOT is_near_dup) OVER (PARTITION BY cluster_id) AS n_orig FROM placed)
        WHERE n_orig < 5 OR NOT is_near_dup""",
    "core": """
        SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY centroid_cos DESC, seq) AS rc
        FROM pool WHERE cluster_id <> -1""",
    "core2": """
        SELECT *, rc <= 7 AS is_core,
               row_number() OVER (PARTITION BY cluster_id, rc <= 7 ORDER BY prior DESC, seq) AS rs,
               count(*) FILTER (rc <= 7) OVER (PARTITION BY cluster_id) AS n_core FROM core""",
    "picked": """
        SELECT *, CASE WHEN is_core THEN 1 WHEN rs <= greatest(0, 13 - n_core) THEN 2 END AS tier FROM core2""",
    "cover": """
        SELECT p.*, row_number() OVER (PARTITION BY cluster_id, source ORDER BY seq) AS first_no,
               count(tier) OVER (PARTITION BY cluster_id, source) AS n_cov FROM picked p""",
    "chosen": """
        SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY t,
                 CASE WHEN t = 1 THEN rc WHEN t = 2 THEN rs END, CASE WHEN t = 3 THEN source END) AS pos
        FROM (SELECT *, CASE WHEN tier IS NOT NULL THEN tier WHEN first_no = 1 AND n_cov = 0 THEN 3 END AS t FROM cover)
        WHERE t IS NOT NULL""",
    "quotes": "SELECT * FROM chosen WHERE pos <= 15",
    "blocks": """
        SELECT cluster_id, count(*) AS n_quotes,
               string_agg('[' || id || '] (' || source
                 || CASE WHEN rating IS NOT NULL THEN ' | rating: ' || CAST(CAST(rating AS INTEGER) AS VARCHAR) || '/5' ELSE '' END
                 || CASE WHEN ts IS NOT NULL THEN ' | ' || strftime(ts, '%Y-%m-%d') ELSE '' END
                 || ') ' || text, chr(10) ORDER BY pos) AS quotes_block
        FROM quotes GROUP BY cluster_id""",
    "sizes": """
        SELECT cluster_id, sum(n) AS n_items, string_agg(source || ': ' || n, ', ' ORDER BY n DESC, source) AS breakdown
        FROM parts GROUP BY cluster_id""",
    "heads": """
        SELECT cluster_id, id, text_clean AS head,
               row_number() OVER (PARTITION BY cluster_id ORDER BY seq) AS r
        FROM cl WHERE cluster_id <> -1""",
    "made": """
        SELECT cluster_id, 'Theme ' || cluster_id AS theme_name, max(head) FILTER (r = 1) AS summary,
               list(id ORDER BY r) AS ids, cluster_id % 5 + 1 AS severity,
               (['low', 'medium', 'high'])[cluster_id % 3 + 1] AS effort
        FROM heads WHERE r <= 3 GROUP BY cluster_id""",
    "cited": """
        SELECT cluster_id, CASE cluster_id % 4 WHEN 0 THEN ids
                 WHEN 1 THEN list_transform(ids, lambda x: regexp_replace(x, '^[^:]*:', ''))
                 WHEN 2 THEN list_append(ids, 'nobody:0') ELSE [] END AS cited FROM made""",
    "wanted": "SELECT cluster_id, unnest(cited) AS c, generate_subscripts(cited, 1) AS pos FROM cited",
    "found": """
        SELECT w.cluster_id, w.pos, w.c, bool_or(m.id = w.c) AS exact, count(DISTINCT m.id) AS n, min(m.id) AS one
        FROM wanted w LEFT JOIN cl m ON m.cluster_id = w.cluster_id
         AND (m.id = w.c OR regexp_replace(m.id, '^[^:]*:', '') = w.c OR ends_with(m.id, w.c))
        GROUP BY w.cluster_id, w.pos, w.c""",
    "resolved": "SELECT *, CASE WHEN exact THEN c WHEN n = 1 THEN one END AS rid FROM found",
    "verdict": """
        SELECT d.cluster_id, coalesce(v.n > 0 AND v.bad = 0, false) AS passed,
               CASE WHEN v.n IS NULL THEN 'LLM cited no evidence quotes'
                    WHEN v.bad > 0 THEN 'LLM cited ' || v.bad || ' unknown quote id(s): [' || array_to_string(
                         list_transform((list_sort(v.unknown))[1:3], lambda x: '''' || x || ''''), ', ') || ']'
                    ELSE 'all ' || v.n || ' cited quote ids verified as cluster members' END AS detail,
               coalesce(v.ids, []) AS ids
        FROM cited d LEFT JOIN (
          SELECT cluster_id, count(*) AS n, count(*) FILTER (rid IS NULL) AS bad,
                 list(c) FILTER (rid IS NULL) AS unknown, list(coalesce(rid, c) ORDER BY pos) AS ids
          FROM resolved GROUP BY cluster_id) v ON v.cluster_id = d.cluster_id""",
    "ins": """
        SELECT r.*, m.theme_name, m.summary, m.effort, v.passed, v.detail, v.ids AS cited_ids
        FROM ranked r JOIN made m ON m.cluster_id = r.cluster_id JOIN verdict v ON v.cluster_id = r.cluster_id""",
    "totals": """
        SELECT sum(n) AS n_items, string_agg(source || ': ' || n, ', ' ORDER BY n DESC, source) AS breakdown
        FROM (SELECT source, count(*) AS n FROM sig GROUP BY source)""",
    "themed": """
        SELECT s.*, coalesce(i.theme_name, 'Unclustered') AS theme FROM sig s LEFT JOIN ins i ON i.cluster_id = s.cluster_id""",
}

CTES["low_joined"] = CTES["low"].replace("FROM tok", "FROM joined")
CTES["hit_phrased"] = CTES["hit"].replace("JOIN lexicon", "JOIN phrased")
SENTIMENT = ["lexicon", "tok", "low", "word", "hit", "val", "mood", "sig"]
BASE = ["tickets0", "fb", "cleaned", "cl"]
SIG = BASE + ["flagged"] + SENTIMENT
SCORE = SIG + ["members:sig", "cohere", "parts", "stats", "norms", "scored", "conf", "ranked"]
QUOTES = SIG + ["members:sig", "dims", "cent", "placed", "pool", "core", "core2", "picked", "cover", "chosen", "quotes"]
MADE = ["heads", "made", "cited", "wanted", "found", "resolved", "verdict"]
INSIGHT = SCORE + MADE + ["ins"]


def _q(ctes: list[str], sql: str) -> str:
    parts, seen = [], set()
    for name in ctes:
        if name in seen:
            continue
        seen.add(name)
        if name.startswith("members:"):
            parts.append(f"members AS (SELECT * FROM {name.split(':')[1]})")
        elif ":" in name:
            parts.append(f"{name.split(':')[0]} AS ({CTES[name.split(':')[1]]})")
        else:
            parts.append(f"{name} AS ({CTES[name]})")
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + sql


def _case(column: str, labels: dict, default: str) -> str:
    whens = " ".join(f"WHEN {_text(k) if isinstance(k, str) else k} THEN {_text(v)}" for k, v in labels.items())
    return f"CASE {column} {whens} ELSE {default} END"


TS = "strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp"
VEC = ["vec", "members:vec"]
_badge = _case("badge", BADGE_LABELS, "badge")
_key = "sha256(concat_ws(chr(31), 'local', 'extractive', {v}, '{s}', {sys}, {user}))"
_cluster_prompt = (
    f"printf({_text(CLUSTER_PROMPT)}, z.n_items::BIGINT, z.breakdown, b.n_quotes::BIGINT, b.quotes_block)"
)
_theme_line = (
    "printf('- %s (priority %.2f, n=%d, severity %d/5, confidence: %s): %s', theme_name, priority_score, "
    "n_items, severity, badge, summary)"
)
_synthesis_prompt = f"printf({_text(SYNTHESIS_PROMPT)}, t.n_items::BIGINT, t.breakdown, b.block)"
_topnames = """
  top AS (SELECT theme_name, row_number() OVER (ORDER BY priority_score DESC, cluster_id) AS r FROM ins
          WHERE badge = 'ok' OR (SELECT count(*) FROM ins WHERE badge = 'ok') = 0),
  names AS (SELECT list(theme_name ORDER BY r) AS t FROM top WHERE r <= 3),
  fall AS (SELECT CASE WHEN len(t) > 0 THEN 'Top issue: ' || t[1] ELSE 'No themes' END AS headline,
           'No synthesis is available for this run; the top priorities are: ' || array_to_string(t, '; ') || '.' AS summary,
           array_to_string(t, '|') AS suggested_focus FROM names)
"""


def _wilson(level: int, z: float) -> str:
    zz = f"({z} * {z})::DOUBLE"
    half = f"{z}::DOUBLE * sqrt(p * (1 - p) / n + {zz} / (4.0 * n * n))"
    return (
        f"round(greatest(0, (p + {zz} / n / 2 - {half}) / (1 + {zz} / n)), 4) AS low_{level}, "
        f"round(least(1, (p + {zz} / n / 2 + {half}) / (1 + {zz} / n)), 4) AS high_{level}"
    )


ORACLES: dict[str, str] = {
    "ingest_reviews": """
        SELECT 'play_store_review:' || d.doc_id AS id, d.doc_id AS seq, 'play_store_review' AS source, d.text AS text,
               CAST(CASE l.quality WHEN 1 THEN 4 WHEN 0 THEN 2 END - l.toxic AS DOUBLE) AS rating,
               strftime(e.ts, '%Y-%m-%d %H:%M:%S') AS timestamp, substr(sha1(e.user_id::VARCHAR), 1, 12) AS author_hash
        FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN events e ON e.event_id = d.doc_id""",
    "ingest_tickets": """
        SELECT 'support_ticket:' || conv_id || '-' || turn AS id, text,
               strftime(make_timestamp((1500000000 + conv_id * 3600 + turn * 60) * 1000000), '%Y-%m-%d %H:%M:%S') AS timestamp,
               substr(sha1(conv_id::VARCHAR), 1, 12) AS author_hash
        FROM (SELECT conv_id, turn, role, trim(regexp_replace('@Support_1 ' || text, '@[\\p{L}\\p{N}_]+', '', 'g'), chr(10) || chr(9) || chr(13) || ' ') AS text
              FROM conversations) WHERE role = 'user'""",
    "ticket_prefilter": """
        SELECT conv_id, turn, text FROM conversations WHERE role = 'user' AND contains(lower(text), 'the ')""",
    "starters_only": """
        SELECT conv_id, turn FROM conversations
        WHERE turn = 0 OR (SELECT count(*) FROM conversations WHERE turn = 0) < 5""",
    "starters": """
        SELECT conv_id, turn FROM conversations
        WHERE turn = 0 OR (SELECT count(*) FROM conversations WHERE turn = 0) < 500""",
    "ingest_all": """
        SELECT 'play_store_review:' || doc_id AS id, doc_id AS seq, 'play_store_review' AS source, md5(text) AS text_md5 FROM documents
        UNION ALL
        SELECT 'support_ticket:' || conv_id || '-' || turn, 17592186044416 + conv_id * 1000 + turn, 'support_ticket',
               md5(trim(regexp_replace('@Support_1 ' || text, '@[\\p{L}\\p{N}_]+', '', 'g'), chr(10) || chr(9) || chr(13) || ' '))
        FROM conversations WHERE role = 'user'""",
    "ingest_generic": """
        SELECT 'app_review_web:' || d.doc_id AS id, 'app_review_web' AS source,
               CAST(CASE l.quality WHEN 1 THEN 4 WHEN 0 THEN 2 END - l.toxic AS DOUBLE) AS rating,
               strftime(e.ts, '%Y-%m-%d %H:%M:%S') AS timestamp, md5(d.text) AS text_md5
        FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN events e ON e.event_id = d.doc_id""",
    "map_columns": """
        SELECT d.doc_id AS doc_id, md5(d.text) AS text_md5,
               CAST(CASE l.quality WHEN 1 THEN 4 WHEN 0 THEN 2 END - l.toxic AS VARCHAR) AS rating_text,
               strftime(e.ts, '%Y-%m-%d %H:%M:%S') AS time_text
        FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN events e ON e.event_id = d.doc_id""",
    "item_ids": """
        SELECT doc_id, source || ':' || doc_id AS native_id, source || ':row' || doc_id AS fallback_id FROM documents""",
    "coerce_rating": """
        SELECT event_id, CASE event_id % 5 WHEN 0 THEN (props->>'$.k')::DOUBLE WHEN 1 THEN (props->>'$.k')::DOUBLE + 0.5 END AS rating
        FROM events""",
    "coerce_time": """
        SELECT event_id, CASE event_id % 5 WHEN 0 THEN epoch_us(ts) // 1000000 WHEN 1 THEN epoch_us(ts) // 1000000 - 7200
               WHEN 2 THEN epoch_us(ts) // 1000000 END AS epoch FROM events""",
    "author_hash": "SELECT event_id, substr(sha1(user_id::VARCHAR), 1, 12) AS author_hash FROM events",
    "dataset_names": """
        SELECT doc_id, coalesce(nullif(b, ''), 'upload') AS slug, replace(coalesce(nullif(b, ''), 'upload'), '-', '_') AS source_slug,
               upper(substr(lang, 1, 1)) || lower(substr(lang, 2)) || ' Feedback ' || upper(substr(source, 1, 1)) || lower(substr(source, 2)) AS title
        FROM (SELECT doc_id, lang, source, trim(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '-') AS b FROM documents)""",
    "most_recent_cut": "SELECT event_id FROM events ORDER BY ts DESC NULLS LAST, event_id LIMIT 500",
    "most_recent": "SELECT event_id FROM events ORDER BY ts DESC NULLS LAST, event_id LIMIT 30000",
    "fixed_sample": _q(["tickets0", "fb"], "SELECT id FROM fb ORDER BY md5(id || '#42'), id LIMIT 300"),
    "clean_text": _q(["tickets0", "fb", "cleaned"], "SELECT id, text_clean FROM cleaned"),
    "page_urls": "SELECT page_id, " + _clean("'see ' || url || ' by @user_' || page_id || ' ✓ ok'") + " AS text_clean FROM pages",
    "length_filter": _q(BASE[:3], "SELECT id, length(text_clean) AS n_chars FROM cleaned WHERE length(text_clean) >= 30"),
    "clean_stats": _q(BASE[:3], """
        SELECT count(*) AS input, count(*) FILTER (length(text_clean) < 30) AS dropped_too_short,
               0::BIGINT AS dropped_wrong_language, count(*) FILTER (length(text_clean) >= 30) AS output FROM cleaned"""),
    "exact_dedupe": _q(BASE, f"""
        SELECT id, seq, md5(text_clean) AS text_md5 FROM cl QUALIFY row_number() OVER (PARTITION BY {TEXT_KEY} ORDER BY seq) = 1"""),
    "dup_stats": _q(BASE, f"""
        SELECT count(*) AS n_rows, count(DISTINCT {TEXT_KEY}) AS n_distinct, count(*) - count(DISTINCT {TEXT_KEY}) AS n_copies FROM cl"""),
    "fingerprint": _q(BASE, """
        SELECT count(*) AS n_rows, bit_xor(('0x' || substr(h, 1, 15))::BIGINT) AS xor_digest,
               sum(('0x' || substr(h, 17, 8))::BIGINT)::BIGINT AS sum_digest
        FROM (SELECT md5(concat_ws(chr(31), 'tfidf-1024', id, text_clean)) AS h FROM cl)"""),
    "near_dups": """
        SELECT vec_id AS seq, EXISTS (SELECT 1 FROM embeddings a WHERE a.vec_id < b.vec_id
               AND list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) > 0.4) AS is_near_dup FROM embeddings b""",
    "near_dups_text": _q(BASE, r"""
        , uniq AS (SELECT seq, text_clean FROM cl QUALIFY row_number() OVER (PARTITION BY """ + TEXT_KEY + r""" ORDER BY seq) = 1),
        tf AS (SELECT seq, w, count(*) AS n FROM (
                 SELECT seq, unnest(regexp_split_to_array(lower(text_clean), '[^\p{L}\p{N}]+')) AS w FROM uniq)
               WHERE w <> '' GROUP BY seq, w),
        tw AS (SELECT seq, w, n * ln(((SELECT count(*) FROM uniq) + 1.0) / (count(*) OVER (PARTITION BY w) + 1.0)) AS x FROM tf),
        un AS (SELECT seq, w, x / sqrt(sum(x * x) OVER (PARTITION BY seq)) AS x FROM tw),
        near AS (SELECT b.seq FROM un a JOIN un b ON a.w = b.w AND a.seq < b.seq
                 GROUP BY a.seq, b.seq HAVING sum(a.x * b.x) > 0.92)
        SELECT seq, seq IN (SELECT seq FROM near) AS is_near_dup FROM uniq"""),
    "term_weights": _q(BASE, r"""
        , uniq AS (SELECT seq, text_clean FROM cl QUALIFY row_number() OVER (PARTITION BY """ + TEXT_KEY + r""" ORDER BY seq) = 1),
        tf AS (SELECT seq, w, count(*) AS n FROM (
                 SELECT seq, unnest(regexp_split_to_array(lower(text_clean), '[^\p{L}\p{N}]+')) AS w FROM uniq)
               WHERE w <> '' GROUP BY seq, w),
        tw AS (SELECT seq, w, n * ln(((SELECT count(*) FROM uniq) + 1.0) / (count(*) OVER (PARTITION BY w) + 1.0)) AS x FROM tf)
        SELECT seq, w AS term, round(coalesce(x / nullif(sqrt(sum(x * x) OVER (PARTITION BY seq)), 0), 0), 4) AS weight FROM tw"""),
    "pca_energy": """
        WITH x AS (SELECT vec_id AS seq, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS d FROM embeddings)
        SELECT seq, round(sum((v - m) * (v - m)), 4) AS energy FROM (SELECT *, avg(v) OVER (PARTITION BY d) AS m FROM x) GROUP BY seq""",
    "silhouette_linear": _q(VEC, """
        SELECT count(*) AS n_members, round(avg(CASE WHEN n_own = 1 THEN 0 ELSE (b - a) / greatest(a, b) END), 4) AS silhouette FROM (
          SELECT seq, max(n) FILTER (own = other) AS n_own, max(t / (n - 1)) FILTER (own = other) AS a, min(t / n) FILTER (own <> other) AS b
          FROM (SELECT x.seq, x.cluster_id AS own, y.cluster_id AS other, count(*) AS n,
                       sum(list_distance(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) ** 2) AS t
                FROM vec x JOIN vec y ON y.cluster_id <> -1 WHERE x.cluster_id <> -1 GROUP BY ALL) GROUP BY seq)"""),
    "lang_profiles": r"""
        WITH p AS (SELECT doc_id, lang, '_' || regexp_replace(lower(text), '[^\p{L}]+', '_', 'g') || '_' AS t FROM documents),
        g AS (SELECT doc_id, lang, gram, count(*) AS n FROM (
                SELECT doc_id, lang, substr(t, unnest(range(1, length(t) - 1)), 3) AS gram FROM p) GROUP BY ALL),
        c AS (SELECT lang AS profile, gram, sum(n) AS c FROM g WHERE lang IS NOT NULL GROUP BY ALL),
        tot AS (SELECT profile, sum(c) AS total FROM c GROUP BY profile),
        k AS (SELECT DISTINCT gram FROM c),
        lp AS (SELECT tot.profile, k.gram, ln((coalesce(c.c, 0) + 1.0) / (total + (SELECT count(*) FROM k))) AS lp
               FROM k CROSS JOIN tot LEFT JOIN c ON c.profile = tot.profile AND c.gram = k.gram),
        s AS (SELECT doc_id, profile, sum(n * lp) AS score FROM g JOIN lp USING (gram) GROUP BY ALL)
        SELECT doc_id, arg_max(profile, score) AS lang FROM s GROUP BY doc_id""",
    "vector_reuse": _q(BASE, """
        SELECT k AS vector_key, bool_or(labelled) AS known FROM (
          SELECT sha256(concat_ws(chr(31), 'tfidf-1024', text_clean)) AS k,
                 seq IN (SELECT doc_id FROM labels) AS labelled FROM cl) GROUP BY k"""),
    "vector_store": _q(BASE, """
        , k AS (SELECT sha256(concat_ws(chr(31), 'tfidf-1024', text_clean)) AS k, bool_or(seq IN (SELECT doc_id FROM labels)) AS labelled
                FROM cl GROUP BY 1)
        SELECT CASE WHEN labelled THEN 0 ELSE 1 END::BIGINT AS run, k AS vector_key FROM k
        UNION ALL SELECT -1, k FROM k"""),
    "centroid_vectors": _q(VEC + ["dims", "cent"], """
        SELECT cluster_id::BIGINT AS cluster_id, n, dim, round(value, 4) AS value FROM (
          SELECT c.cluster_id, s.n, unnest(c.c) AS value, generate_subscripts(c.c, 1) - 1 AS dim
          FROM cent c JOIN (SELECT cluster_id, count(*) AS n FROM vec GROUP BY cluster_id) s ON s.cluster_id = c.cluster_id)"""),
    "cohesion": _q(VEC + ["cohere"], "SELECT cluster_id::BIGINT AS cluster_id, round(cohesion, 6) AS cohesion FROM cohere"),
    "centroid_rank": _q(VEC + ["dims", "cent"], """
        SELECT v.seq, v.cluster_id::BIGINT AS cluster_id,
               row_number() OVER (PARTITION BY v.cluster_id ORDER BY list_dot_product(v.embedding::DOUBLE[], c.c) DESC, v.seq) AS centroid_rank
        FROM vec v JOIN cent c ON c.cluster_id = v.cluster_id"""),
    "soft_assign": "WITH members AS (SELECT vec_id AS seq, embedding, CASE WHEN label >= 7 THEN -1 ELSE label END AS cluster_id FROM embeddings),\n"
    + f"dims AS ({CTES['dims']}),\ncent AS ({CTES['cent']})" + """,
        best AS (SELECT m.seq, arg_max(c.cluster_id, cos) AS b, max(cos) AS s FROM (
                   SELECT m.seq, c.cluster_id, list_dot_product(m.embedding::DOUBLE[], c.c) AS cos
                   FROM members m JOIN cent c ON m.cluster_id = -1) m JOIN cent c ON c.cluster_id = m.cluster_id GROUP BY m.seq)
        SELECT m.seq, CASE WHEN b.s >= 0.2 THEN b.b ELSE m.cluster_id END::BIGINT AS cluster_id, coalesce(b.s >= 0.2, false) AS from_noise
        FROM members m LEFT JOIN best b ON b.seq = m.seq""",
    "stream_clean": _q(BASE, "SELECT id, md5(text_clean) AS text_md5 FROM cl"),
    "stream_first_copies": _q(BASE, f"""
        SELECT seq FROM cl QUALIFY row_number() OVER (PARTITION BY {TEXT_KEY} ORDER BY ts NULLS LAST, seq) = 1"""),
    "stream_mentions": _q(["tickets0", "fb"], """
        SELECT strftime(ts, '%Y-%m-%d') AS day, source, count(*) AS mentions FROM fb WHERE ts IS NOT NULL GROUP BY ALL"""),
    "stream_assign": "WITH members AS (SELECT vec_id AS seq, embedding, CASE WHEN label >= 7 THEN -1 ELSE label END AS cluster_id FROM embeddings),\n"
    + f"dims AS ({CTES['dims']}),\ncent AS ({CTES['cent']})" + """
        SELECT m.seq, CASE WHEN max(cos) >= 0.2 THEN arg_max(m.c_id, cos) ELSE -1 END::BIGINT AS cluster_id FROM (
          SELECT m.seq, c.cluster_id AS c_id, list_dot_product(m.embedding::DOUBLE[], c.c) AS cos
          FROM members m CROSS JOIN cent c WHERE m.cluster_id = -1 AND m.seq IN (SELECT vec_id FROM embeddings WHERE label >= 7)) m
        GROUP BY m.seq""",
    "silhouette": _q(VEC, """
        SELECT round(avg(CASE WHEN n_own = 1 THEN 0 ELSE (b - a) / greatest(a, b) END), 4) AS silhouette, count(*) AS n_members FROM (
          SELECT seq, max(n) FILTER (own = other) AS n_own, max(t / (n - 1)) FILTER (own = other) AS a, min(t / n) FILTER (own <> other) AS b
          FROM (SELECT x.seq, x.cluster_id AS own, y.cluster_id AS other, count(*) AS n,
                       sum(list_distance(x.embedding::DOUBLE[], y.embedding::DOUBLE[])) AS t
                FROM vec x JOIN vec y ON y.cluster_id <> -1 WHERE x.cluster_id <> -1 GROUP BY ALL) GROUP BY seq)"""),
    "silhouette_sweep": """
        WITH l AS (SELECT vec_id, embedding::DOUBLE[] AS e, [(label + 1) % 3, vec_id % 4, CASE WHEN vec_id < 7 THEN 0 ELSE 1 END] AS labels
                   FROM embeddings),
        pair AS (SELECT x.vec_id, x.labels AS a, y.labels AS b, list_distance(x.e, y.e) AS d FROM l x CROSS JOIN l y),
        flat AS (SELECT vec_id, unnest(a) AS own, unnest(b) AS other, unnest([0, 1, 2]) AS labeling, d FROM pair),
        sums AS (SELECT labeling, vec_id, own, other, count(*) AS n, sum(d) AS t FROM flat GROUP BY ALL)
        SELECT labeling::BIGINT AS labeling, count(*) AS n_members,
               round(avg(CASE WHEN n_own = 1 THEN 0 ELSE (b - a) / greatest(a, b) END), 4) AS silhouette FROM (
          SELECT labeling, vec_id, max(n) FILTER (own = other) AS n_own, max(t / (n - 1)) FILTER (own = other) AS a,
                 min(t / n) FILTER (own <> other) AS b
          FROM sums GROUP BY labeling, vec_id) GROUP BY labeling""",
    "davies_bouldin": _q(VEC + ["dims"], """
        , means AS (SELECT cluster_id, list(x ORDER BY d) AS c FROM dims GROUP BY cluster_id),
        spread AS (SELECT v.cluster_id, m.c, avg(list_distance(v.embedding::DOUBLE[], m.c)) AS s
                   FROM vec v JOIN means m ON m.cluster_id = v.cluster_id GROUP BY v.cluster_id, m.c)
        SELECT round(avg(worst), 4) AS davies_bouldin, count(*) AS n_clusters FROM (
          SELECT a.cluster_id, max((a.s + b.s) / list_distance(a.c, b.c)) AS worst
          FROM spread a JOIN spread b ON a.cluster_id <> b.cluster_id GROUP BY a.cluster_id)"""),
    "sentiment_scores": _q(SIG, "SELECT id, round(sentiment, 4) AS sentiment FROM sig"),
    "sentiment_phrases": _q(BASE + ["lexicon", "tok", "joined", "phrased", "low:low_joined", "word", "hit:hit_phrased", "val", "mood"], """
        SELECT cl.id, round(coalesce(m.sentiment, 0), 4) AS sentiment FROM cl LEFT JOIN mood m ON m.id = cl.id"""),
    "source_age": _q(BASE, """
        SELECT id, round((epoch_us(max(ts) OVER (PARTITION BY source)) - epoch_us(ts)) / 86400000000.0, 4) AS age_days FROM cl"""),
    "severity_prior": _q(SIG, """
        SELECT id, round(CASE WHEN rating IS NOT NULL THEN 0.7 * (5 - rating) / 4 + 0.3 * greatest(0, -sentiment)
               ELSE greatest(0, -sentiment) END, 6)::DOUBLE AS severity_prior FROM sig"""),
    "per_source": _q(BASE, "SELECT source, count(*) AS n_items FROM cl GROUP BY source"),
    "cluster_summary": _q(BASE + ["flagged", "members:flagged", "cohere"], """
        SELECT s.cluster_id, n_items, n_unique, sources, round(coalesce(c.cohesion, 0), 4) AS cohesion FROM (
          SELECT cluster_id, sum(n)::BIGINT AS n_items, sum(u)::BIGINT AS n_unique, string_agg(source || '=' || n, ';' ORDER BY source) AS sources
          FROM (SELECT cluster_id, source, count(*) AS n, count(*) FILTER (NOT is_near_dup) AS u FROM flagged GROUP BY cluster_id, source)
          GROUP BY cluster_id) s LEFT JOIN cohere c ON c.cluster_id = s.cluster_id"""),
    **{
        name: _q(SCORE, f"SELECT cluster_id, round({col}, 4)::DOUBLE AS {col} FROM norms")
        for name, col in (("score_frequency", "f_norm"), ("score_severity", "s_norm"), ("score_recency", "r_norm"), ("score_diversity", "d_norm"))
    },
    "recency_now": _q(BASE, """
        SELECT cluster_id, round(coalesce(avg(exp(-ln(2.0) / 90 * (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts)) / 86400000000.0)), 0.5), 4) AS recency
        FROM cl GROUP BY cluster_id"""),
    "score": _q(SCORE, """
        SELECT cluster_id, priority_score, cf AS c_frequency, cs AS c_severity, cr AS c_recency, cd AS c_diversity,
               n_sources, src AS per_source_counts FROM scored"""),
    "wilson": _q(SIG, "SELECT cluster_id, n, k, " + ", ".join(_wilson(l, z) for l, z in ((95, 1.96), (90, 1.645), (99, 2.576))) + """
        FROM (SELECT *, k / n::DOUBLE AS p FROM (
          SELECT cluster_id, count(*) AS n, count(*) FILTER (sentiment < -0.05) AS k FROM sig GROUP BY cluster_id))"""),
    "confidence": _q(SCORE, """
        SELECT cluster_id, n_items, n_unique, badge, wilson_low, wilson_high, round(p, 4) AS negative_share,
               round(cohesion, 4) AS cohesion, cohesion < 0.35 AS mixed_theme_warning FROM conf"""),
    "score_failed_annotation": _q(SCORE, """
        SELECT cluster_id, priority_score, n_largest FROM scored
        WHERE cluster_id <> (SELECT cluster_id FROM scored ORDER BY n_items DESC, cluster_id LIMIT 1)"""),
    "noise_stats": _q(BASE, """
        SELECT count(DISTINCT cluster_id) FILTER (cluster_id <> -1) AS n_clusters,
               round(avg(CASE WHEN cluster_id = -1 THEN 1.0 ELSE 0.0 END), 4) AS noise_share, 0::BIGINT AS soft_assigned_from_noise FROM cl"""),
    "top_clusters_cut": _q(BASE, """
        SELECT cluster_id, count(*) AS n_items FROM cl WHERE cluster_id <> -1 GROUP BY cluster_id ORDER BY n_items DESC, cluster_id LIMIT 4"""),
    "top_clusters": _q(BASE, """
        SELECT cluster_id, count(*) AS n_items FROM cl WHERE cluster_id <> -1 GROUP BY cluster_id ORDER BY n_items DESC, cluster_id"""),
    "rank_themes": _q(SCORE, "SELECT rank, cluster_id, priority_score, n_items FROM ranked"),
    "quote_pool": _q(BASE + ["flagged"], """
        SELECT id, cluster_id FROM (SELECT *, count(*) FILTER (NOT is_near_dup) OVER (PARTITION BY cluster_id) AS n_orig FROM flagged)
        WHERE n_orig < 5 OR NOT is_near_dup"""),
    "quote_sample": _q(QUOTES, "SELECT cluster_id, id, pos, t::BIGINT AS tier FROM quotes"),
    "prompt_blocks": _q(QUOTES + ["blocks"], "SELECT cluster_id, n_quotes, quotes_block FROM blocks"),
    "prompt_keys": _q(QUOTES + ["blocks", "parts", "sizes"], "SELECT b.cluster_id, z.n_items::BIGINT AS n_items, "
        + _key.format(v=_text(PROMPT_VERSION), s="ClusterAnalysis", sys=_text(SYSTEM_PROMPT), user=_cluster_prompt)
        + " AS prompt_key FROM blocks b JOIN sizes z ON z.cluster_id = b.cluster_id"),
    "annotate_reuse": _q(BASE, """
        SELECT cluster_id, count(*) >= 50 AS cached, true AS answered FROM cl WHERE cluster_id <> -1 GROUP BY cluster_id"""),
    "parse_annotations": _q(BASE, """
        SELECT DISTINCT cluster_id, cluster_id NOT IN (1, 2, 3) AS valid,
               CASE WHEN cluster_id NOT IN (1, 2, 3) THEN 'Theme ' || cluster_id END AS theme_name,
               CASE WHEN cluster_id NOT IN (1, 2, 3) THEN cluster_id % 5 + 1 END::BIGINT AS severity
        FROM cl WHERE cluster_id <> -1"""),
    "citations": _q(BASE + MADE, """
        SELECT cluster_id, passed AS citation_check_passed, detail AS citation_check_detail,
               coalesce(array_to_string(ids, ','), '') AS resolved_ids FROM verdict"""),
    "insights_json": _q(INSIGHT, "SELECT cluster_id, theme_name, badge, n_items FROM ins"),
    "insights_roundtrip": _q(INSIGHT + QUOTES, """
        SELECT i.cluster_id, i.priority_score, i.src AS per_source_counts, q.id AS quote_id
        FROM ins i JOIN quotes q ON q.cluster_id = i.cluster_id WHERE q.pos <= 8"""),
    "run_stats": _q(BASE, f"""
        SELECT (SELECT count(*) FROM cleaned) AS input, (SELECT count(*) FROM cleaned) - count(*) AS dropped_too_short,
               0::BIGINT AS dropped_wrong_language, count(*) AS output, count(*) - count(DISTINCT {TEXT_KEY}) AS exact_copies,
               count(DISTINCT cluster_id) FILTER (cluster_id <> -1) AS n_clusters,
               round(avg(CASE WHEN cluster_id = -1 THEN 1.0 ELSE 0.0 END), 4) AS noise_share FROM cl"""),
    "insight_table": _q(INSIGHT, f"""
        SELECT rank, theme_name AS theme, priority_score AS priority, severity::BIGINT AS severity, n_items AS items, {_badge} AS confidence,
               n_sources AS sources, CASE WHEN passed THEN '✅' ELSE '❌' END AS citations_ok, cluster_id FROM ins"""),
    "report_blocks": _q(INSIGHT + QUOTES, f"""
        SELECT rank, array_to_string(['## ' || rank || '. ' || theme_name,
          printf('**Priority %.2f** · severity %d/5 · %d items · ', priority_score, severity, n_items) || {_badge},
          '', summary, '', '**Hypothesized root causes:**', '- Cause ' || i.cluster_id, '', '**Recommended actions:**',
          '- **Check theme ' || i.cluster_id || '** (effort: ' || effort || ') — Seen in feedback', '', '**Evidence sample:**', e.ev, ''], chr(10)) AS block
        FROM ins i JOIN (SELECT cluster_id, string_agg('> ' || substr(text, 1, 300) || ' — _' || source || '_', chr(10) ORDER BY pos) AS ev
                         FROM quotes WHERE pos <= 3 GROUP BY cluster_id) e ON e.cluster_id = i.cluster_id"""),
    "insight_files": _q(INSIGHT, """
        SELECT cluster_id, theme_name, badge, n_items, priority_score, false AS broken FROM ins
        UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, true WHERE EXISTS (SELECT * FROM ins)"""),
    "insight_csv": _q(INSIGHT, f"""
        SELECT rank::VARCHAR AS rank, theme_name AS theme, n_items AS items, {_badge} AS confidence, n_sources::VARCHAR AS sources,
               CASE WHEN passed THEN '✅' ELSE '❌' END AS citations_ok, cluster_id FROM ins"""),
    "largest_file": """
        SELECT source, count(*) AS n_rows, 21 * count(*) AS n_bytes, max(doc_id) AS last_id
        FROM documents GROUP BY source ORDER BY count(*) DESC, source LIMIT 1""",
    "dataset_store": """
        SELECT lang || '-feedback' AS dataset, count(*) AS n_rows, count(*) AS n_read, max(doc_id) AS last_id
        FROM documents WHERE lang <> 'en' OR doc_id % 2 = 0 GROUP BY lang""",
    "workspaces": "SELECT DISTINCT lang || '-feedback' AS workspace FROM documents",
    "filter_insights": _q(INSIGHT, """
        SELECT cluster_id, priority_score FROM ins WHERE n_items >= 30 AND badge = 'ok'
          AND list_contains(list_transform(string_split(src, ';'), lambda x: split_part(x, '=', 1)), 'src3')
          AND list_contains(list_transform(string_split(src, ';'), lambda x: split_part(x, '=', 1)), 'src5')"""),
    "theme_join": _q(INSIGHT + ["themed"], "SELECT theme, count(*) AS n_items FROM themed GROUP BY theme"),
    "search_unicode": _q(INSIGHT + ["themed"], "SELECT id, source, theme FROM themed WHERE regexp_matches(text, '(?i)ÉMENT|ÜCHT|ÑAS')"),
    "search": _q(INSIGHT + ["themed"], f"""
        SELECT id, source, theme, rating, round(sentiment, 4) AS sentiment, {TS} FROM themed WHERE regexp_matches(text, '(?i)th(e|at) .*with')"""),
    "search_indexed": _q(INSIGHT + ["themed"], f"""
        SELECT id, source, theme, rating, round(sentiment, 4) AS sentiment, {TS} FROM themed WHERE regexp_matches(text, '(?i)th(e|at) .*with')"""),
    "search_unicode_indexed": _q(INSIGHT + ["themed"], "SELECT id, source, theme FROM themed WHERE regexp_matches(text, '(?i)ÉMENT|ÜCHT|ÑAS')"),
    "fold_themes": _q(INSIGHT + ["themed"], """
        SELECT CASE WHEN theme = 'Unclustered' OR theme IN (SELECT theme FROM themed WHERE theme <> 'Unclustered'
                 GROUP BY theme ORDER BY count(*) DESC, theme LIMIT 4) THEN theme ELSE 'Other themes' END AS theme_view, count(*) AS n_items
        FROM themed GROUP BY 1"""),
    "theme_members": _q(INSIGHT, "SELECT id, cluster_id FROM sig WHERE cluster_id = (SELECT cluster_id FROM ins WHERE rank = 1)"),
    "monthly_trend": _q(INSIGHT, """
        SELECT strftime(ts, '%Y-%m-%d') AS month, count(*) AS mentions FROM sig
        WHERE cluster_id = (SELECT cluster_id FROM ins WHERE rank = 1) AND ts IS NOT NULL GROUP BY 1"""),
    "monthly_orders": "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS mentions FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1",
    "month_source_pivot": "SELECT strftime(o_orderdate, '%Y-%m') AS month, "
        + ", ".join(f"count(*) FILTER (o_orderpriority LIKE '{i}-%') AS p{i}" for i in range(1, 6))
        + " FROM orders GROUP BY 1",
    "describe_by_source": _q(SIG, """
        SELECT source, count(*) AS count, round(avg(sentiment), 6) AS mean, round(stddev_samp(sentiment), 6) AS std, round(min(sentiment), 6) AS min,
               round(quantile_cont(sentiment, 0.25), 6) AS p25, round(quantile_cont(sentiment, 0.5), 6) AS p50,
               round(quantile_cont(sentiment, 0.75), 6) AS p75, round(max(sentiment), 6) AS max FROM sig GROUP BY source"""),
    "length_hist": _q(BASE, """
        SELECT least(50, floor((length(text_clean) - lo) * 50 / (hi - lo)::DOUBLE)::BIGINT + 1) AS bin, count(*) AS n
        FROM cl, (SELECT min(length(text_clean)) AS lo, max(length(text_clean)) AS hi FROM cl) GROUP BY 1"""),
    "dup_share": _q(BASE + ["flagged"], """
        SELECT cluster_id, round(avg(is_near_dup::INT), 4) AS near_dup_share FROM flagged WHERE cluster_id <> -1
        GROUP BY cluster_id ORDER BY avg(is_near_dup::INT) DESC, cluster_id LIMIT 10"""),
    "rating_dist": _q(BASE, "SELECT rating, count(*) AS n_items FROM cl WHERE rating IS NOT NULL GROUP BY rating"),
    "kpis": _q(INSIGHT, """
        SELECT (SELECT count(*) FROM sig) AS n_items, (SELECT count(DISTINCT source) FROM sig) AS n_sources, count(*) AS n_themes,
               count(*) FILTER (badge <> 'ok') AS n_low_confidence, count(*) FILTER (passed) AS n_citations_ok FROM ins"""),
    "badge_hist": _q(INSIGHT, "SELECT badge, count(*) AS n FROM ins GROUP BY badge"),
    "labels_map": _q(INSIGHT, f"SELECT cluster_id, {_badge} AS badge, {_case('severity', SEVERITY_MARKS, chr(39) + '⚪' + chr(39))} || ' ' || severity || '/5' AS severity FROM ins"),
    "source_labels": _q(BASE, """
        SELECT CASE source WHEN 'support_ticket' THEN '🎫 Support ticket' ELSE source END AS label, count(*) AS n_items FROM cl GROUP BY 1"""),
    "insight_detail": _q(INSIGHT + QUOTES, """
        SELECT q.cluster_id, q.pos - 1 AS pos, q.id, concat_ws('  ·  ', CASE q.source WHEN 'support_ticket' THEN '🎫 Support ticket' ELSE q.source END,
               CASE WHEN q.rating IS NOT NULL THEN CAST(q.rating AS INTEGER) || '★' END, strftime(q.ts, '%Y-%m-%d')) AS meta,
               list_contains(i.cited_ids, q.id) AS starred
        FROM quotes q JOIN ins i ON i.cluster_id = q.cluster_id WHERE q.pos <= 8"""),
    "sample_per_cluster": _q(BASE, """
        SELECT cluster_id, pick, id, replace(substr(text, 1, 160), '|', '/') AS text FROM (
          SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY md5(id || '#42'), id) AS pick FROM cl
          WHERE cluster_id IN (SELECT cluster_id FROM cl WHERE cluster_id <> -1 GROUP BY cluster_id ORDER BY count(*) DESC, cluster_id LIMIT 5))
        WHERE pick <= 5"""),
    "last_turns": """
        SELECT conv_id, string_agg(CASE role WHEN 'user' THEN 'PM' ELSE 'Analyst' END || ': ' || text, chr(10) ORDER BY turn) AS history
        FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 6 GROUP BY conv_id""",
    "chat_prompts": """
        SELECT conv_id, md5(string_agg(CASE role WHEN 'user' THEN 'PM' ELSE 'Analyst' END || ': ' || text, chr(10) ORDER BY turn)
               || chr(10) || 'PM: What should we fix first?' || chr(10) || 'Analyst:') AS prompt_md5
        FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 6 GROUP BY conv_id""",
    "fallback_summary": _q(INSIGHT, ", " + _topnames + " SELECT headline, summary, suggested_focus FROM fall"),
    "synthesis_context": _q(INSIGHT + ["totals"], f""",
        b AS (SELECT string_agg({_theme_line}, chr(10) ORDER BY rank) AS block FROM ins)
        SELECT b.block AS themes_block, """
        + _key.format(v=_text(PROMPT_VERSION), s="ExecutiveSummary", sys=_text(SYNTHESIS_SYSTEM), user=_synthesis_prompt)
        + " AS prompt_key FROM b, totals t"),
    "grounding_text": _q(INSIGHT + ["totals"], ", " + _topnames + """,
        b AS (SELECT string_agg(rank || '. ' || printf('%s — priority %.2f, severity %d/5, %d items, confidence: %s', theme_name, priority_score, severity, n_items, badge)
              || chr(10) || '   Summary: ' || summary || chr(10) || '   Root causes: Cause ' || cluster_id
              || chr(10) || '   Recommended actions: Check theme ' || cluster_id || ' (effort ' || effort || ')', chr(10) ORDER BY rank) AS block
              FROM ins WHERE rank <= 15)
        SELECT array_to_string(['Corpus: ' || format('{:,}', t.n_items::BIGINT) || ' feedback items (' || t.breakdown || '); '
               || (SELECT count(*) FROM ins) || ' analyzed themes.', 'Executive summary: ' || f.summary, '', 'Ranked themes (by priority score 0-1):', b.block], chr(10)) AS context
        FROM b, totals t, fall f"""),
}

ORACLES["cluster_eval"] = f"""
    SELECT 'clusters' AS metric, (SELECT count(DISTINCT label) FROM embeddings)::DOUBLE AS value
    UNION ALL SELECT 'silhouette', (SELECT silhouette FROM ({ORACLES['silhouette']}))
    UNION ALL SELECT 'davies_bouldin', (SELECT davies_bouldin FROM ({ORACLES['davies_bouldin']}))
    UNION ALL SELECT 'noise_share', (SELECT avg(CASE WHEN label = -1 THEN 1.0 ELSE 0.0 END) FROM embeddings)"""


#: Squarings of the covariance matrix: a power of 2^14 leaves its first eigenvector alone.
SQUARINGS = 14


def _axis(matrix: str, name: str) -> list[str]:
    """CTEs that end in ``name`` (i, v): the first eigenvector of a matrix (i, j, v), its
    largest entry positive, and ``name``_value, its eigenvalue."""
    out, last = [], matrix
    for step in range(SQUARINGS):
        made = f"{name}_{step}"
        out.append(f"""{made} AS MATERIALIZED (SELECT i, j, v / sqrt(sum(v * v) OVER ()) AS v FROM (
            SELECT a.i, b.j, sum(a.v * b.v) AS v FROM {last} a JOIN {last} b ON a.j = b.i GROUP BY a.i, b.j))""")
        last = made
    out.append(f"""{name} AS MATERIALIZED (SELECT i, v / sqrt(sum(v * v) OVER ()) * sign(arg_max(v, abs(v)) OVER ()) AS v
        FROM {last} WHERE j = (SELECT arg_max(j, v) FROM {last} WHERE i = j))""")
    out.append(f"""{name}_value AS (SELECT sum(a.v * m.v * b.v) AS v FROM {matrix} m JOIN {name} a ON a.i = m.i JOIN {name} b ON b.i = m.j)""")
    return out


def _plane(rows: str) -> str:
    """CTEs that end in ``plane`` (seq, pca_x, pca_y) for rows (seq, embedding)."""
    parts = [
        f"""centred AS MATERIALIZED (SELECT seq, d, v - avg(v) OVER (PARTITION BY d) AS v FROM (
            SELECT seq, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS d FROM {rows} WHERE embedding IS NOT NULL))""",
        "cov AS MATERIALIZED (SELECT a.d AS i, b.d AS j, sum(a.v * b.v) AS v FROM centred a JOIN centred b USING (seq) GROUP BY a.d, b.d)",
        *_axis("cov", "first"),
        """rest AS MATERIALIZED (SELECT c.i, c.j, c.v - (SELECT v FROM first_value) * a.v * b.v AS v
            FROM cov c JOIN first a ON a.i = c.i JOIN first b ON b.i = c.j)""",
        *_axis("rest", "second"),
        """plane AS (SELECT seq, sum(c.v * a.v) AS pca_x, sum(c.v * b.v) AS pca_y
            FROM centred c JOIN first a ON a.i = c.d JOIN second b ON b.i = c.d GROUP BY seq)""",
    ]
    return ",\n".join(parts)


ORACLES["pca_coords"] = "WITH " + _plane("(SELECT vec_id AS seq, embedding FROM embeddings)") + """
    SELECT seq, round(pca_x, 4) AS pca_x, round(pca_y, 4) AS pca_y FROM plane"""
ORACLES["map_points"] = _q(INSIGHT + ["themed"], ", " + _plane("themed") + """
    SELECT t.id, round(p.pca_x, 4) AS pca_x, round(p.pca_y, 4) AS pca_y, t.source, substr(t.text, 1, 110) AS short_text,
           CASE WHEN theme = 'Unclustered' OR theme IN (SELECT theme FROM themed WHERE theme <> 'Unclustered'
                GROUP BY theme ORDER BY count(*) DESC, theme LIMIT 12) THEN theme ELSE 'Other themes' END AS theme_view
    FROM themed t JOIN plane p ON p.seq = t.seq""")
