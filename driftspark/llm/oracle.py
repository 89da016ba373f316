"""SQL for the queries that SQL can express, for DuckDB over the same tables."""

from driftspark.llm.rules import BOILERPLATE, SEPARATORS, SYMBOLS

_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BLANK = r"[\x20\x09-\x0D]"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_PHRASES = " OR ".join(f"contains(lower(line), '{p}')" for p in BOILERPLATE)

ORACLE: dict[str, str] = {
    "op3_near_duplicates": rf"""
        WITH RECURSIVE d AS (
            SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(coalesce({_LOW}, ''), '{_BLANK}+'), lambda x: x <> '') AS w FROM documents),
        s AS (SELECT rid, doc_id, CASE len(w) WHEN 0 THEN [] WHEN 1 THEN w ELSE
            list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS items FROM d),
        u AS (SELECT rid, doc_id, len(items) AS n, unnest(items) AS item FROM s),
        links AS (SELECT a.rid AS a, b.rid AS b FROM u AS a JOIN u AS b USING (item) WHERE a.rid <> b.rid
            GROUP BY a.rid, b.rid, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
        reached AS (SELECT rid AS a, rid AS b FROM s UNION SELECT r.a, l.b FROM reached AS r JOIN links AS l ON r.b = l.a),
        named AS (SELECT r.a AS rid, min(s.doc_id) AS component_id FROM reached AS r JOIN s ON s.rid = r.b GROUP BY r.a)
        SELECT s.doc_id, CAST(len(s.items) AS BIGINT) AS n_shingles, component_id, s.doc_id = component_id AS kept
        FROM s JOIN named USING (rid)""",
    "op7_decontamination": rf"""
        WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce({_LOW}, ''), '{_WORD}') AS w FROM documents),
        i AS (SELECT item_id, regexp_extract_all(coalesce({_LOW}, ''), '{_WORD}') AS w FROM benchmark),
        iw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, unnest(list_transform(range(1, len(w) - least(10, len(w)) + 2),
            lambda p: array_to_string(list_slice(w, p, p + least(10, len(w)) - 1), ' '))) AS win FROM i WHERE len(w) > 0),
        dw AS (SELECT rid, n, p, array_to_string(list_slice(w, p, p + n - 1), ' ') AS win
            FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
        hits AS (SELECT rid, n, p, item_id FROM dw JOIN iw USING (n, win)),
        words AS (SELECT rid, count(DISTINCT pos) AS n_hit FROM (SELECT rid, unnest(range(p, p + n)) AS pos FROM hits) GROUP BY rid),
        found AS (SELECT rid, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
            FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS id FROM hits WHERE item_id IS NOT NULL) GROUP BY rid)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
            sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN words USING (rid) LEFT JOIN found USING (rid)""",
    "op8_quality_rules": rf"""
        WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
        w AS (SELECT rid, list_filter(string_split_regex(text, '{_BLANK}+'), lambda x: x <> '') AS w FROM d),
        win AS (SELECT rid, p, array_to_string(list_slice(w, p, p + 7), ' ') AS win
            FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS p FROM w WHERE len(w) >= 8)),
        often AS (SELECT rid, win FROM win GROUP BY rid, win HAVING count(*) > 1),
        rep AS (SELECT rid, count(DISTINCT pos) AS r FROM (SELECT rid, unnest(range(p, p + 8)) AS pos FROM win JOIN often USING (rid, win)) GROUP BY rid),
        line AS (SELECT rid, line, length(regexp_replace(line, '{_BLANK}', '', 'g')) AS solid
            FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d)),
        judged AS (SELECT rid, line, solid, NOT (
            length(line) - length(translate(line, '{SEPARATORS}', '')) >= 2
            OR length(line) - length(translate(line, '{SYMBOLS}!', '')) > 0.15 * solid
            OR (length(line) < 60 AND solid > 0 AND NOT regexp_matches(line, '[.!?…:;"''”’»)\]]{_BLANK}*$'))
            OR (length(line) < 200 AND ({_PHRASES}))) AS passes FROM line),
        lines AS (SELECT rid, count(*) FILTER (WHERE solid > 0) - count(DISTINCT line) FILTER (WHERE solid > 0) AS dup,
            coalesce(sum(solid) FILTER (WHERE passes), 0) AS left_over, sum(solid) AS solid FROM judged GROUP BY rid),
        all_of AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(solid AS BIGINT) AS word_chars,
            CAST(length(text) - length(translate(text, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols, dup AS n_dup_lines,
            coalesce(r, 0) AS n_repeat_words, left_over FROM d JOIN w USING (rid) JOIN lines USING (rid) LEFT JOIN rep USING (rid))
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
            n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
            NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words)
                AND (CASE WHEN word_chars > 0 THEN 1 - CAST(left_over AS DOUBLE) / word_chars ELSE 0 END) <= 0.5 AS kept FROM all_of""",
    "op12_hard_negatives": """
        WITH p AS (SELECT row_number() OVER () AS uid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
            FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
                AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.uid, a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same,
                CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM p AS a, p AS b WHERE a.vec_id % 100 = 0 AND a.uid <> b.uid),
        pos AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY score DESC, other NULLS LAST) AS j FROM s WHERE same) WHERE j <= 5),
        neg AS (SELECT pos.anchor_id, pos.other AS positive_id, s.other AS negative_id, pos.score AS positive_score, s.score AS negative_score,
                row_number() OVER (PARTITION BY pos.uid, pos.j ORDER BY s.score DESC, s.other NULLS LAST) AS r
            FROM pos JOIN s ON s.uid = pos.uid AND NOT s.same AND 80 * pos.score <= 100 * s.score AND s.score <= pos.score)
        SELECT anchor_id, positive_id, CAST(r AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM neg WHERE r <= 5""",
    "op13_suffix_dedup": """
        WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
        w AS (SELECT rid, i, x[2 * i + 1 : 2 * i + 800] AS win FROM (SELECT rid, x, unnest(range(CAST(len(x) // 2 - 399 AS BIGINT))) AS i FROM d WHERE len(x) >= 800)),
        again AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY md5_number(win)) AS n FROM w) WHERE n > 1),
        runs AS (SELECT rid, i, sum(CASE WHEN i - before <= 400 THEN 0 ELSE 1 END) OVER (PARTITION BY rid ORDER BY i) AS run
            FROM (SELECT rid, i, coalesce(lag(i) OVER (PARTITION BY rid ORDER BY i), -1000) AS before FROM again)),
        spans AS (SELECT rid, min(i) AS s, max(i) + 400 AS e FROM runs GROUP BY rid, run),
        cut AS (SELECT rid, s, e, coalesce(lag(e) OVER (PARTITION BY rid ORDER BY s), 0) AS done FROM spans),
        per AS (SELECT rid, count(*) AS n, sum(e - s) AS gone, max(e) AS last, string_agg(x[2 * done + 1 : 2 * s], '' ORDER BY s) AS kept
            FROM cut JOIN d USING (rid) GROUP BY rid)
        SELECT doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans,
            sha256(unhex(CASE WHEN n IS NULL THEN x ELSE kept || x[2 * last + 1 :] END)) AS kept_sha256
        FROM d LEFT JOIN per USING (rid)""",
}
