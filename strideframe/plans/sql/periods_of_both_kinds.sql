-- with epochs, wear_choi, rich
SELECT subject, 'wear' AS kind, start_index, end_index
FROM (
  SELECT subject, min(epoch) AS start_index, max(epoch) AS end_index, count(*) AS n_epochs
  FROM (
    SELECT *, epoch - row_number() OVER (PARTITION BY subject, wear_time ORDER BY epoch) AS g
    FROM d)
  WHERE wear_time
  GROUP BY subject, g)
UNION ALL
SELECT subject, 'non-wear' AS kind, start_index, end_index
FROM (
  SELECT subject, min(epoch) AS start_index, max(epoch) AS end_index, count(*) AS n_epochs
  FROM (
    SELECT *, epoch - row_number() OVER (PARTITION BY subject, wear_time ORDER BY epoch) AS g
    FROM d)
  WHERE NOT wear_time
  GROUP BY subject, g)
