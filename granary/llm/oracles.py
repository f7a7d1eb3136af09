"""DuckDB statements for the queries that SQL can express."""

ORACLES = {
    "op4_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
    """,
    "op5_mixing": r"""
        WITH sized AS (
            SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                   md5('mix:' || doc_id) AS key FROM documents
        ), sources AS (
            SELECT source, sum(size)::BIGINT AS source_size,
                   row_number() OVER (ORDER BY source IS NULL, source) - 1 AS place FROM sized GROUP BY source
        ), weighed AS (
            SELECT *, (CASE place % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END)::DOUBLE AS weight, 2 * source_size AS most FROM sources
        ), leveled AS (
            SELECT *, most / weight AS level,
                   (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE
                    - coalesce(sum(most) OVER (ORDER BY most / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
                   / sum(weight) OVER (ORDER BY most / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS water
            FROM weighed
        ), filled AS (
            SELECT source, source_size, least(most::DOUBLE, weight * (SELECT arg_min(water, (level, place)) FROM leveled WHERE water <= level)) AS target
            FROM leveled
        ), placed AS (
            SELECT s.doc_id, s.size, f.source_size, f.target, floor(f.target)::BIGINT AS goal,
                   sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - s.size AS before
            FROM sized s JOIN filled f ON s.source IS NOT DISTINCT FROM f.source
        )
        SELECT doc_id, size, source_size, target,
               (CASE WHEN source_size > 0 THEN goal // source_size ELSE 0 END * size
                + greatest(0, least(size, CASE WHEN source_size > 0 THEN goal % source_size ELSE 0 END - before)))::BIGINT AS taken
        FROM placed
    """,
}
