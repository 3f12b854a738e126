"""The views in SQL, to be put before a query's own text."""

VIEWS = {
    "version_log": """version_log AS (SELECT 'b' || (user_id % 4) AS bucket, (user_id % 10) || '/' || user_id AS key, event_id AS seq, epoch_us(ts) AS created,
        CAST(round(value * 100) AS BIGINT) AS size, event_type = 'error' AS marker, md5(CAST(event_id AS VARCHAR)) AS etag, event_type AS kind, user_id, value, props FROM events)""",
    "ranked": """ranked AS (SELECT *, row_number() OVER (PARTITION BY bucket, key ORDER BY seq DESC) AS nth FROM version_log)""",
    "files": """files AS (SELECT o_orderkey AS file, o_custkey AS owner, epoch_us(o_orderdate) AS made, o_orderstatus AS status FROM orders)""",
    "extents": """extents AS (SELECT file, ordinal, e AS "end", e - length AS start, length, block, volume FROM (SELECT l_orderkey AS file,
        row_number() OVER w AS ordinal, CAST(l_quantity AS BIGINT) AS length, l_partkey AS block, l_suppkey AS volume,
        CAST(sum(CAST(l_quantity AS BIGINT)) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS e
        FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice)))""",
    "volumes": """volumes AS (SELECT s_suppkey AS volume, n_nationkey AS node, r_name AS domain, s_acctbal AS bytes FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)""",
    "parts": """parts AS (SELECT conv_id AS upload, turn AS part, role, text AS body FROM conversations)""",
    "objects": """objects AS (SELECT doc_id AS object, text AS body FROM documents)""",
}


def over(*views: str, body: str) -> str:
    return ("WITH " + ", ".join(VIEWS.get(v, v) for v in views) + " " if views else "") + body
