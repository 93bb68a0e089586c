-- with epochs
SELECT subject, epoch, CASE WHEN axis1 >= 0 AND axis1 <= 100 THEN 'sedentary' WHEN axis1 >= 101 AND axis1 <= 1951 THEN 'light'
  WHEN axis1 >= 1952 AND axis1 <= 5724 THEN 'moderate' WHEN axis1 >= 5725 AND axis1 <= 9498 THEN 'vigorous'
  WHEN axis1 >= 9499 THEN 'very_vigorous' END AS level
FROM e
