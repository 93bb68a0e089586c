-- with epochs
SELECT subject, epoch, round((greatest(2.32 + 0.000389 * axis1, 0))::DOUBLE, 6) AS mets
FROM e
