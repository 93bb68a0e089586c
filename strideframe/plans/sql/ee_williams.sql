-- with epochs
SELECT subject, epoch, round((axis1 * 4 * 0.0000191 * 70.0)::DOUBLE, 6) AS kcal_per_min
FROM e
