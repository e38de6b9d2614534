"""SQL views over the driver's tables, counterparts of ``fixtures``."""

VIEWS = {
    "bars": """SELECT CAST(l_suppkey AS VARCHAR) AS symbol, CAST(l_shipdate AS DATE) AS date,
        max(l_extendedprice) AS open, max(l_extendedprice) AS high, min(l_extendedprice) AS low,
        max(l_extendedprice) AS close, sum(l_quantity) AS volume FROM lineitem GROUP BY 1, 2""",
    "bars_events": "SELECT CAST(user_id AS VARCHAR) AS symbol, ts AS date, event_id AS id, value AS close FROM events",
    "hot_bars": """SELECT CASE WHEN event_id % 3 = 0 THEN 'HOT' ELSE CAST(user_id AS VARCHAR) END AS symbol,
        ts AS date, event_id AS id, value AS close FROM events""",
    "trades": """SELECT event_id AS id, user_id, 'S' || CAST(k % 5 AS VARCHAR) AS symbol,
        CASE WHEN event_type IN ('purchase', 'view', 'signup') THEN 'BUY' ELSE 'SELL' END AS transaction_type,
        k % 10 + 1 AS quantity, value AS price, ts AS timestamp
        FROM (SELECT *, CAST(props::JSON->>'$.k' AS BIGINT) AS k FROM events)""",
    "hot_trades": """SELECT id, CASE WHEN id % 3 = 0 THEN -1 ELSE user_id END AS user_id,
        CASE WHEN id % 3 = 0 THEN 'HOT' ELSE symbol END AS symbol, transaction_type, quantity, price, timestamp
        FROM trades""",
    "msgs": """SELECT conv_id * 1000 + turn AS id, CAST(conv_id AS VARCHAR) AS session_id, text AS message,
        role = 'user' AS is_user, turn AS seq FROM conversations""",
    "hot_msgs": """SELECT conv_id * 1000 + turn AS id,
        CASE WHEN conv_id % 3 = 0 THEN 'HOT' ELSE CAST(conv_id AS VARCHAR) END AS session_id, text AS message,
        role = 'user' AS is_user, conv_id * 1000 + turn AS seq FROM conversations""",
    "sessions": """SELECT conv_id % 50 AS user_id, CAST(conv_id AS VARCHAR) AS session_id, max(turn) AS last
        FROM conversations GROUP BY conv_id""",
    "users": """SELECT c_custkey AS id, c_name AS username,
        'c' || CAST(c_custkey AS VARCHAR) || '@example.org' AS email, c_custkey * 3600 AS created FROM customer""",
    "holdings": """SELECT c_custkey AS id, c_custkey % 150 AS user_id,
        'S' || CAST(c_custkey // 150 AS VARCHAR) AS symbol, c_custkey % 40 + 1 AS quantity,
        abs(c_acctbal) AS average_price FROM customer""",
    "registrations": """SELECT c_custkey AS arrival, 'u' || CAST(c_custkey * c_custkey % 397 AS VARCHAR) AS username,
        'e' || CAST((c_custkey * c_custkey * c_custkey + 11 * c_custkey) % 491 AS VARCHAR) AS email FROM customer""",
    "family_registrations": """SELECT c_custkey AS arrival,
        'u' || CAST(c_custkey // 60 AS VARCHAR) || '-' || CAST(c_custkey * c_custkey % 17 AS VARCHAR) AS username,
        'e' || CAST(c_custkey // 60 AS VARCHAR) || '-' || CAST((c_custkey * c_custkey * c_custkey + 11 * c_custkey) % 23 AS VARCHAR) AS email
        FROM customer""",
    "news": """SELECT doc_id AS arrival, substring(text, 1, 80) AS headline, text AS summary,
        'https://example.org/' || CAST(doc_id AS VARCHAR) AS url, source, lang, doc_id * 3600 AS epoch
        FROM documents""",
    "quotes": """SELECT CAST(p_partkey AS VARCHAR) AS symbol, p_retailprice AS price,
        CAST(p_size - 25 AS DOUBLE) AS change, p_partkey * 10 AS volume FROM part""",
    "quotes_a": """SELECT CAST(p_partkey AS VARCHAR) AS symbol, p_retailprice AS price,
        CASE WHEN p_partkey % 7 = 0 THEN -0.5 ELSE CAST(p_size - 25 AS DOUBLE) END AS change,
        CASE WHEN p_partkey % 7 = 0 THEN 0.0
             ELSE CAST(CAST(p_size - 25 AS VARCHAR) || '.25' AS DOUBLE) END AS change_percent,
        CASE WHEN p_partkey % 7 = 0 THEN 0 ELSE p_partkey * 10 END AS volume,
        CASE WHEN p_partkey % 7 = 0 THEN '2024-02-01' ELSE '2024-01-05' END AS latest_trading_day
        FROM part WHERE p_partkey % 3 = 0""",
    "quotes_b": """SELECT CAST(p_partkey AS VARCHAR) AS symbol, p_retailprice AS price,
        CASE WHEN p_partkey % 5 = 0 THEN 0.0 ELSE 1.5 END::DOUBLE AS change,
        CASE WHEN p_partkey % 5 = 0 THEN 0.0 ELSE 0.25 END::DOUBLE AS change_percent,
        CASE WHEN p_partkey % 5 = 0 THEN 0.0 ELSE p_retailprice END AS high,
        CASE WHEN p_partkey % 5 = 0 THEN 0.0 ELSE p_retailprice END AS low,
        CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE p_partkey END AS volume,
        CASE WHEN p_partkey % 5 = 0 THEN '1970-01-01'
             ELSE strftime(DATE '1970-01-01' + CAST(p_partkey AS INTEGER), '%Y-%m-%d') END AS latest_trading_day
        FROM part WHERE p_partkey % 3 = 1
        AND (p_partkey % 5 = 0 OR (p_partkey % 11 <> 0 AND p_partkey % 13 <> 0))""",
    "rules": """SELECT priority::BIGINT AS priority, keyword, tag FROM (VALUES (1, 'license', 'legal'), (2, 'sch', 'german'), (3, 'und', 'german'),
        (4, 'les', 'french'), (5, 'the', 'english'), (6, 'tion', 'any')) AS r(priority, keyword, tag)""",
}


def sql(body: str, *views: str, recursive: bool = False) -> str:
    """``body`` with the named views in front; a view may use those before it."""
    head = ",\n".join(f"{v} AS ({VIEWS[v]})" for v in views)
    word = "WITH RECURSIVE" if recursive else "WITH"
    rest = body.strip()
    joint = ", " if rest.startswith("+") else " "
    return f"{word} {head}{joint}{rest.lstrip('+ ')}"
