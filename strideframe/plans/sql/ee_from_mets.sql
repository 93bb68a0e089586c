-- with epochs
SELECT subject, round((sum((1.602 + 0.000638 * axis1) * 3.5 * 70.0 / 200))::DOUBLE, 6) AS kcal
FROM e
GROUP BY subject
