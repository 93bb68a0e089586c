-- with epochs
SELECT subject, epoch, round((greatest(0.751 + 0.0008198 * axis1, 0))::DOUBLE, 6) AS mets
FROM e
