"""DuckDB SQL for the queries that SQL can express."""

_NORMALISED = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')"

#: crc32 as a macro would have it: the table by its rule, then one step a byte of a text's UTF-8.
_CRC_TABLE = "(SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t)"


def _crc32(text: str) -> str:
    """The crc32 of a text in a query that has _CRC_TABLE's column t in scope."""
    digits = f"hex(encode({text}))"
    byte = f"(instr('0123456789ABCDEF', substr({digits}, 2 * i + 1, 1)) - 1) * 16 + instr('0123456789ABCDEF', substr({digits}, 2 * i + 2, 1)) - 1"
    steps = f"list_transform(range(octet_length(encode({text}))), lambda i: {byte})"
    folded = f"list_reduce(list_prepend(4294967295::BIGINT, {steps}), lambda c, b: xor(c // 256, t[(xor(c, b::BIGINT) % 256) + 1]))"
    return f"xor({folded}, 4294967295)"


SQL = {
    "op13_rolling_features": f"""
        WITH h AS (SELECT doc_id, source, lang, length(text) AS len, {_crc32("doc_id::VARCHAR")} AS h FROM documents, {_CRC_TABLE}),
        d AS (SELECT *, 60 * ((doc_id + h % 4000) // 6) AS event_s FROM h),
        w AS (SELECT unnest([3600, 21600]) AS window_s),
        e AS (SELECT DISTINCT source, event_s FROM d),
        x AS (SELECT e.source, e.event_s, window_s, count(d.event_s) AS n_events, coalesce(sum(d.len), 0) AS sum_chars, count(DISTINCT d.lang) AS n_langs,
                     list_sort(list(d.len) FILTER (d.len IS NOT NULL)) AS l
              FROM e CROSS JOIN w LEFT JOIN d ON d.source IS NOT DISTINCT FROM e.source AND d.event_s >= e.event_s - window_s AND d.event_s < e.event_s
              GROUP BY ALL)
        SELECT d.doc_id, x.window_s::BIGINT AS window_s, d.event_s::BIGINT AS event_s, x.n_events, x.sum_chars::BIGINT AS sum_chars, x.n_langs,
               l[(len(l) + 1) // 2] AS median_chars, l[(3 * len(l) + 3) // 4] AS high_chars
        FROM d JOIN x ON d.source IS NOT DISTINCT FROM x.source AND d.event_s = x.event_s
    """,
    "op2_exact_dedup": f"""
        WITH d AS (SELECT doc_id, {_NORMALISED} AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY t)
    """,
    # integral products of these vectors are far below 2^53, so sums of doubles are exact
    "op8_knn_join": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
                   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, d.vec_id, list_dot_product(q.e, d.e)::BIGINT AS score
              FROM v q JOIN v d ON q.vec_id % 50 = 0 AND d.vec_id <> q.vec_id AND len(q.e) = len(d.e)),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
    # near words share what is left when a letter goes at one place of both, or of the longer one
    "op11_spelling_variants": f"""
        WITH RECURSIVE r AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
                             FROM documents),
        k AS (SELECT doc_id, run, count(*) AS times FROM r WHERE length(run) >= 7 GROUP BY ALL),
        h AS (SELECT run, times, {_crc32("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM k, {_CRC_TABLE}),
        o AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, times FROM h),
        w AS (SELECT word, sum(times)::BIGINT AS n FROM o WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2),
        d AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM w)),
        p AS (SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM d a JOIN d b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
              UNION SELECT a.word, a.n, b.word, b.n FROM d a JOIN w b ON a.rest = b.word
              UNION SELECT b.word, b.n, a.word, a.n FROM d a JOIN w b ON a.rest = b.word),
        s AS (SELECT word, n, count(*) AS n_near, min((-other_n, other)) AS best FROM p GROUP BY ALL),
        f AS (SELECT w.word, w.n, coalesce(s.n_near, 0) AS n_near, CASE WHEN -best[1] >= 10 * w.n THEN best[2] END AS form, CASE WHEN -best[1] >= 10 * w.n THEN -best[1] END AS form_n
              FROM w LEFT JOIN s USING (word)),
        c AS (SELECT word, word AS root FROM f WHERE form IS NULL UNION ALL SELECT f.word, c.root FROM c JOIN f ON f.form = c.word)
        SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM f JOIN c USING (word)
    """,
}
