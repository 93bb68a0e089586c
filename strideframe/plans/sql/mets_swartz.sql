-- with epochs
SELECT subject, epoch, round((greatest(2.606 + 0.0006863 * axis1, 0))::DOUBLE, 6) AS mets
FROM e
