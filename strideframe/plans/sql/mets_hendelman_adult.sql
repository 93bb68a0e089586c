-- with epochs
SELECT subject, epoch, round((greatest(1.602 + 0.000638 * axis1, 0))::DOUBLE, 6) AS mets
FROM e
