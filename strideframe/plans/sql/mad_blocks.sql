-- with epochs
SELECT subject, block, round((avg(abs(v - m)))::DOUBLE, 6) AS mad
FROM (
  SELECT *, avg(v) OVER (PARTITION BY subject, block) AS m, count(*) OVER (PARTITION BY subject, block) AS n
  FROM (
    SELECT subject, (sample - 1) // 50 AS block, sqrt(x*x + y*y + z*z) AS v
    FROM r))
WHERE n = 50
GROUP BY ALL
