-- with epochs
SELECT subject, epoch, round((greatest(CASE WHEN vm * 4 > 2453 THEN 0.001064 * vm + 0.087512 * 70.0 - 5.500229 ELSE 0 END,
  0))::DOUBLE, 6) AS kcal_per_min
FROM e
