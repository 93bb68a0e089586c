-- with epochs
SELECT subject, epoch, CASE WHEN axis1 >= 0 AND axis1 <= 150 THEN 'sedentary' WHEN axis1 >= 151 AND axis1 <= 2200 THEN 'light'
  WHEN axis1 >= 2201 AND axis1 <= 6000 THEN 'moderate' WHEN axis1 >= 6001 AND axis1 <= 10000 THEN 'vigorous'
  WHEN axis1 >= 10001 THEN 'very_vigorous' END AS level
FROM e
