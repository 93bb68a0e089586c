-- with epochs
SELECT subject, epoch, round((greatest(2.240 + 0.0006 * axis1, 0))::DOUBLE, 6) AS mets
FROM e
