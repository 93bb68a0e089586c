-- with epochs
SELECT subject, epoch, CASE WHEN vm >= 0 AND vm <= 100 THEN 'sedentary' WHEN vm >= 101 AND vm <= 1951 THEN 'light'
  WHEN vm >= 1952 AND vm <= 5724 THEN 'moderate' WHEN vm >= 5725 AND vm <= 9498 THEN 'vigorous'
  WHEN vm >= 9499 THEN 'very_vigorous' END AS level
FROM e
