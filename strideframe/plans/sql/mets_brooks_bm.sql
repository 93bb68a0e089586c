-- with epochs
SELECT subject, epoch, round((greatest(3.33 + 0.00037 * axis1 - 0.012 * 70.0, 0))::DOUBLE, 6) AS mets
FROM e
