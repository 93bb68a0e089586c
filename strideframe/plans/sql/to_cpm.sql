-- with epochs
SELECT subject, epoch, round((axis1 * 60.0 / 15)::DOUBLE, 6) AS cpm
FROM e
