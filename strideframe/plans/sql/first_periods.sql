-- with epochs, wear_choi, rich
SELECT subject, start_index, n_epochs
FROM (
  SELECT subject, min(epoch) AS start_index, max(epoch) AS end_index, count(*) AS n_epochs
  FROM (
    SELECT *, epoch - row_number() OVER (PARTITION BY subject, wear_time ORDER BY epoch) AS g
    FROM d)
  WHERE wear_time
  GROUP BY subject, g)
ORDER BY n_epochs DESC, subject, start_index
LIMIT 5
