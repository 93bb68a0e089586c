-- with epochs
SELECT subject, epoch, round((greatest(CASE WHEN axis1 * 4 > 1951 THEN 0.00094 * axis1 * 4 + (0.1346 * 70.0 - 7.37418)
  ELSE 3.5 * 70.0 / 200 END, 3.5 * 70.0 / 200))::DOUBLE, 6) AS kcal_per_min
FROM e
