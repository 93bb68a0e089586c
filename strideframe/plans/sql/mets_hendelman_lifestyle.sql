-- with epochs
SELECT subject, epoch, round((greatest(2.922 + 0.000409 * axis1, 0))::DOUBLE, 6) AS mets
FROM e
