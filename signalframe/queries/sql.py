"""Common table expressions of the DuckDB counterparts."""

SAMPLES = "samples AS (SELECT user_id AS signal_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS n, value AS x FROM events)"
CENTRED = SAMPLES + ", means AS (SELECT signal_id, avg(x) AS m FROM samples GROUP BY 1), cent AS (SELECT signal_id, n, round(x - m, 9) AS x FROM samples JOIN means USING (signal_id))"
VECTORS = "vectors AS (SELECT vec_id AS signal_id, CAST(unnest(range(len(embedding))) AS BIGINT) AS n, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)"
HOPS = CENTRED + """, lagged AS (SELECT *, n // 10 AS hop, lag(x) OVER (PARTITION BY signal_id ORDER BY n) AS p FROM cent),
hops AS (SELECT signal_id, hop, count(*) AS size, CASE WHEN sqrt(avg(x * x)) > 1e-9 THEN 20 * log10(sqrt(avg(x * x))) ELSE -120 END AS energy_db,
    count(*) FILTER (n % 10 <> 0 AND (x >= 0) <> (p >= 0)) / count(*) AS zcr FROM lagged GROUP BY 1, 2 HAVING count(*) = 10)"""
GATED = HOPS + """, ranked AS (SELECT *, row_number() OVER (PARTITION BY signal_id ORDER BY energy_db) AS r, count(*) OVER (PARTITION BY signal_id) AS c FROM hops),
f0 AS (SELECT signal_id, energy_db AS floor0 FROM ranked WHERE r = floor((c - 1) * 0.1 + 0.5) + 1),
g0 AS (SELECT hops.*, floor0, energy_db > floor0 + 10 AND (zcr < 0.6 OR energy_db > floor0 + 25) AS sp FROM hops JOIN f0 USING (signal_id)),
r1 AS (SELECT signal_id, energy_db, row_number() OVER (PARTITION BY signal_id ORDER BY energy_db) AS r, count(*) OVER (PARTITION BY signal_id) AS c FROM g0 WHERE NOT sp),
f1 AS (SELECT signal_id, energy_db AS floor1 FROM r1 WHERE r = floor((c - 1) * 0.1 + 0.5) + 1),
marked AS (SELECT g0.signal_id, hop, energy_db, zcr, zcr AS flatness, coalesce(floor1, floor0) AS floor_db,
    energy_db > coalesce(floor1, floor0) + 10 AND (zcr < 0.6 OR energy_db > coalesce(floor1, floor0) + 25) AS speech FROM g0 LEFT JOIN f1 USING (signal_id))"""
SEGMENTS = "segments AS (SELECT conv_id, turn AS seg, turn * 60.0::DOUBLE AS s_start, turn * 60.0::DOUBLE + 40 AS s_end, coalesce(text, '') AS text FROM conversations)"
WORDS = """words AS (SELECT conv_id, turn * 100000 + pos AS word, text, round(turn * 60.0::DOUBLE + pos * 0.4::DOUBLE, 2) AS "start", round(turn * 60.0::DOUBLE + pos * 0.4::DOUBLE + 0.3::DOUBLE, 2) AS "end", ((pos * 37 + turn * 11) % 100) / 100 AS confidence
FROM (SELECT conv_id, turn, unnest(range(len(string_split(coalesce(text, ''), ' ')))) AS pos, unnest(string_split(coalesce(text, ''), ' ')) AS text FROM conversations))"""
TURNS = """turns AS (SELECT conv_id, turn AS ord, turn * 60.0::DOUBLE - (turn % 3) * 5 AS t_start, turn * 60.0::DOUBLE - (turn % 3) * 5 + 30 + (turn % 4) * 12 AS t_end,
    CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 ELSE 2 END AS speaker FROM conversations)"""


def islands(table: str, key: str, order: str, flag: str) -> str:
    """Runs of rows with a flag: key, s, e, length."""
    return f"""(SELECT {key}, min({order}) AS s, max({order}) AS e, count(*) AS length FROM (SELECT {key}, {order}, {order} - row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS g FROM {table} WHERE {flag}) GROUP BY {key}, g)"""
