-- with epochs
s AS (
  SELECT subject, sample AS i, y - avg(y) OVER (PARTITION BY subject) AS v, count(*) OVER (PARTITION BY subject) AS n
  FROM r),
acf AS (
  SELECT a.subject, k, any_value(a.n) AS n, sum(a.v * b.v) AS c
  FROM s a
  CROSS JOIN range(31) t(k)
  JOIN s b ON b.subject = a.subject AND b.i = a.i + k
  GROUP BY a.subject, k),
scaled AS (
  SELECT subject, k, n, c / first_value(c) OVER o AS c, first_value(c) OVER o AS c0
  FROM acf
  WINDOW o AS (PARTITION BY subject ORDER BY k)),
around AS (
  SELECT *, lag(c) OVER o AS before, lead(c) OVER o AS after
  FROM scaled
  WHERE k > 0
  WINDOW o AS (PARTITION BY subject ORDER BY k)),
best AS (
  SELECT subject, arg_max(k, c) AS k
  FROM around
  WHERE before < c AND after < c
  GROUP BY subject)
SELECT t.subject, CASE WHEN t.n >= 60 AND t.c0 > 1e-12 * greatest(1, t.n) AND 30 / b.k * 60 BETWEEN 60 AND 200
    THEN round_even(30::DOUBLE / b.k * 60 * t.n / 30 / 60, 0)::BIGINT ELSE 0 END AS steps
FROM (
  SELECT subject, n, c0
  FROM scaled
  WHERE k = 0) t
LEFT JOIN best b ON b.subject = t.subject
