sb AS (
  SELECT *, n_epochs::DOUBLE AS duration
  FROM (
    SELECT subject, min(epoch) AS start_index, max(epoch) AS end_index,
      strftime(min(timestamp), '%Y-%m-%d %H:%M:%S') AS start_time, strftime(max(timestamp), '%Y-%m-%d %H:%M:%S') AS end_time,
      count(*) AS n_epochs
    FROM (
      SELECT *, epoch - row_number() OVER (PARTITION BY subject, f ORDER BY epoch) AS g
      FROM (
        SELECT *, coalesce(intensity = 'sedentary' AND wear_time, FALSE) AS f
        FROM d))
    WHERE f
    GROUP BY subject, g))
