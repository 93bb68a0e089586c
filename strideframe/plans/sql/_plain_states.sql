states AS (
  SELECT *
  FROM ck)
