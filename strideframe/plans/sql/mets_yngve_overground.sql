-- with epochs
SELECT subject, epoch, round((greatest(1.136 + 0.0008249 * axis1, 0))::DOUBLE, 6) AS mets
FROM e
