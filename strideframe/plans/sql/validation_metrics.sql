-- with epochs
SELECT subject, count(*) AS n, round((avg(axis1 - vm))::DOUBLE, 6) AS bias, round((avg(abs(axis1 - vm)))::DOUBLE, 6) AS mae,
  round((avg(CASE WHEN vm <> 0 THEN 100 * (axis1 - vm) / vm END))::DOUBLE, 6) AS mpe,
  round((sqrt(avg(pow(axis1 - vm, 2))))::DOUBLE, 6) AS rmse, round((corr(axis1, vm))::DOUBLE, 6) AS pearson_r,
  round((var_samp((axis1 + vm) / 2) / (var_samp((axis1 + vm) / 2) + avg(pow(axis1 - vm, 2) / 2)))::DOUBLE, 6) AS icc,
  round((avg(axis1 - vm) - 1.96 * stddev_samp(axis1 - vm))::DOUBLE, 6) AS loa_lower,
  round((avg(axis1 - vm) + 1.96 * stddev_samp(axis1 - vm))::DOUBLE, 6) AS loa_upper
FROM e
GROUP BY subject
