-- with epochs
SELECT subject, epoch, CASE WHEN 7.601 - 0.065 * coalesce(sum(c) OVER a,
  0) / 11 - 1.08 * sum(CASE WHEN c >= 50 AND c < 100 THEN 1
  ELSE 0 END) OVER a - 0.056 * sqrt(greatest((sum(c * c) OVER b - pow(sum(c) OVER b, 2) / 6) / 5,
  0)) - 0.703 * ln(c + 1) > -4 THEN 'S' ELSE 'W' END AS sleep_wake
FROM (
  SELECT *, least(axis1, 300) AS c
  FROM e)
WINDOW a AS (PARTITION BY subject ORDER BY epoch ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING),
b AS (PARTITION BY subject ORDER BY epoch ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)
