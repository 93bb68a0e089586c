-- with epochs
SELECT subject, epoch, round((greatest(2.757 + 0.0015 * axis1 - 0.08957 * 12.0 - 0.000038 * axis1 * 12.0, 0))::DOUBLE, 6) AS mets
FROM e
