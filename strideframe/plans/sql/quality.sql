-- with epochs
SELECT subject, count(*) AS n_samples, count(*) FILTER (WHERE x IS NULL) AS missing_x,
  count(*) FILTER (WHERE y IS NULL) AS missing_y, count(*) FILTER (WHERE z IS NULL) AS missing_z,
  round((avg(sqrt(x*x + y*y + z*z)))::DOUBLE, 6) AS mean_magnitude,
  count(*) FILTER (WHERE sqrt(x*x + y*y + z*z) > 1.5) AS outliers, 0.0::DOUBLE AS percent_missing
FROM r
GROUP BY subject
