-- with epochs, wear_choi, rich
SELECT subject, epoch, axis1
FROM d
WHERE (subject, date) IN (
  SELECT (subject, date)
  FROM d
  GROUP BY subject, date
  HAVING sum(wear_time::INT) >= 600)
