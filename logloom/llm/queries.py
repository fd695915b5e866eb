"""The queries of this subpackage, and the SQL of those that it can express; tests compare the others with brute force instead."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from logloom.llm import dedup, mix, neighbours, split, subjects, tokens


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p2_found": dedup.p2_found,
        "p2_records": dedup.p2_records,
        "p5_found": neighbours.p5_found,
        "p5_neighbours": neighbours.p5_neighbours,
        "p5_recall": neighbours.p5_recall,
        "p6_found": split.p6_found,
        "p6_pieces": split.p6_pieces,
        "p8_ids": tokens.p8_ids,
        "p8_places": tokens.p8_places,
        "p9_mix": mix.p9_mix,
        "p9_shares": mix.p9_shares,
        "p9_shares_exact": mix.p9_shares_exact,
        "p9_leaves": mix.p9_leaves,
        "p10_found": subjects.p10_found,
        "p10_composition": subjects.p10_composition,
    }


def oracle_sql() -> dict[str, str]:
    marks = ",;。！？；，"
    return {
        # All pairs, which only SQL on the small table may do.
        "p5_found": """
            WITH v AS MATERIALIZED (SELECT point_no AS p, vector::DOUBLE[128] AS x FROM vector_points WHERE len(vector) = 128 AND NOT list_bool_or(list_transform(vector, lambda e: e IS NULL OR isnan(e) OR isinf(e))) AND NOT list_bool_and(list_transform(vector, lambda e: e = 0))),
            near AS (SELECT a.p AS a, b.p AS b FROM v a, v b WHERE a.p <> b.p QUALIFY row_number() OVER (PARTITION BY a.p ORDER BY round(array_cosine_similarity(a.x, b.x), 9) DESC, b.p) <= 5)
            SELECT DISTINCT least(a, b) AS point_a, greatest(a, b) AS point_b FROM near""",
        "p6_found": rf"""
            WITH t AS (SELECT 'chunk' AS item_kind, chunk_no AS item_id, text FROM log_chunks UNION ALL SELECT 'message', log_id, message FROM log_entries)
            SELECT item_kind, item_id, CAST(list_max(list_transform(regexp_split_to_array(text, '[\t-\r\x1C-\x1F\x{{85}}\p{{Z}}{marks}]'), lambda w: strlen(w))) > max_bytes AS BIGINT) AS forced
            FROM t JOIN split_limits USING (item_kind) WHERE item_id IS NOT NULL AND strlen(text) > max_bytes""",
    }
