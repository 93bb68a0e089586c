-- with epochs
SELECT subject, epoch, round((greatest(0.000863 * vm + 0.668876, 0))::DOUBLE, 6) AS mets
FROM e
