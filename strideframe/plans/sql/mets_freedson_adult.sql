-- with epochs
SELECT subject, epoch, round((greatest(greatest((CASE WHEN axis1 > 1951 THEN 0.00094 * axis1 + 0.1346 * 70.0 - 7.37418
  ELSE axis1 * 0.0000191 * 70.0 END) * 200 / (70.0 * 3.5), 1.0), 0))::DOUBLE, 6) AS mets
FROM e
