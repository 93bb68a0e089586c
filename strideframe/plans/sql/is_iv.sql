-- with epochs, wear_choi, rich
sl AS (
  SELECT subject, date, hour, avg(CASE WHEN wear_time THEN axis1 END) AS x, count(CASE WHEN wear_time THEN axis1 END) AS k
  FROM d
  WHERE wear_time
  GROUP BY ALL),
sm AS (
  SELECT *, avg(x) OVER (PARTITION BY subject) AS m, x - lag(x) OVER (PARTITION BY subject ORDER BY date, hour) AS st
  FROM sl),
a AS (
  SELECT subject, count(*) AS n, sum(k) AS k, sum(pow(x - m, 2)) AS total, sum(st * st) AS steps
  FROM sm
  GROUP BY subject),
b AS (
  SELECT subject, sum(pow(xh - m, 2)) AS bt
  FROM (
    SELECT subject, hour, avg(x) AS xh, any_value(m) AS m
    FROM sm
    GROUP BY subject, hour)
  GROUP BY subject)
SELECT subject, round((CASE WHEN k >= 48 AND total > 0 THEN greatest(0, least(1, n * bt / (24 * total))) END)::DOUBLE,
  6) AS interdaily_stability, round((CASE WHEN k >= 48 AND total > 0 AND n > 1 THEN n * steps / ((n - 1) * total) END)::DOUBLE,
  6) AS intradaily_variability
FROM a
JOIN b USING (subject)
