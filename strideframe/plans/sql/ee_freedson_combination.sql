-- with epochs
SELECT subject, epoch, round((greatest(CASE WHEN axis1 * 4 > 1951 THEN 4 * (0.00094 * axis1 * 4 + (0.1346 * 70.0 - 7.37418))
  ELSE axis1 * 4 * 0.0000191 * 70.0 END, 0))::DOUBLE, 6) AS kcal_per_min
FROM e
