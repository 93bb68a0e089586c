-- with epochs
SELECT subject, w AS "window", round((avg(x))::DOUBLE, 6) AS mean_x, round((avg(y))::DOUBLE, 6) AS mean_y,
  round((avg(z))::DOUBLE, 6) AS mean_z
FROM (
  SELECT *, (sample - 1) // 10 AS w
  FROM r)
GROUP BY subject, w
HAVING count(*) = 10 AND stddev_samp(x) < 0.013 AND stddev_samp(y) < 0.013 AND stddev_samp(z) < 0.013
