-- with epochs
SELECT subject, epoch, CASE WHEN m < 1.5 THEN 'sedentary' WHEN m < 3 THEN 'light' WHEN m < 6 THEN 'moderate'
  WHEN m < 9 THEN 'vigorous' ELSE 'very_vigorous' END AS level
FROM (
  SELECT *, 1.602 + 0.000638 * axis1 AS m
  FROM e)
