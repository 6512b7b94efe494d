"""What the queries' SQL forms share: the same series as orrery.sources.series gives, as common table expressions for DuckDB."""

EV = """ev AS (SELECT event_type AS channel, CAST((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 3600000000 AS BIGINT) AS seq,
  CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS v FROM events GROUP BY 1, 2),
s AS (SELECT c.channel, g.seq, g.seq * 3600.0::DOUBLE AS t, ev.v FROM (SELECT DISTINCT event_type AS channel FROM events) c CROSS JOIN (SELECT unnest(range((SELECT min(seq) FROM ev), (SELECT max(seq) FROM ev) + 1)) AS seq) g
  LEFT JOIN ev ON ev.channel = c.channel AND ev.seq = g.seq)"""

#: s with neighbours' known samples and f, filled linearly.
FILLED = EV + """,
k AS (SELECT *, CASE WHEN v IS NOT NULL THEN seq END AS ks FROM s),
n AS (SELECT *, last_value(ks IGNORE NULLS) OVER (p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s0, last_value(v IGNORE NULLS) OVER (p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v0,
  first_value(ks IGNORE NULLS) OVER (p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS s1, first_value(v IGNORE NULLS) OVER (p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v1
  FROM k WINDOW p AS (PARTITION BY channel ORDER BY seq)),
f AS (SELECT channel, seq, t, v, s0, v0, s1, v1, CASE WHEN v IS NOT NULL THEN v WHEN s0 IS NULL THEN v1 WHEN s1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * (seq - s0) / (s1 - s0) END AS f FROM n)"""

#: Runs of flagged rows of a table `m(channel, seq, t, v, flag, ...)` as `r`, one row each with its own run number.
RUNS = """g AS (SELECT *, coalesce(flag, false) AS fl FROM m),
h AS (SELECT *, CASE WHEN fl IS DISTINCT FROM lag(fl) OVER (PARTITION BY channel ORDER BY seq) THEN 1 ELSE 0 END AS b FROM g),
r AS (SELECT *, sum(b) OVER (PARTITION BY channel ORDER BY seq) AS run FROM h)"""
