e0 AS (
  SELECT 's' || (user_id % 4) AS subject, event_id, coalesce(value, 0.0) AS value,
    row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) AS epoch
  FROM events),
e1 AS (
  SELECT subject, epoch, event_id * 7919 % 1000 AS h,
    CASE WHEN (epoch - 1) % 1440 < 420 OR ((epoch - 1) // 200) % 4 = 1 THEN CASE
    WHEN event_id * 7919 % 1000 < 30 THEN CAST(event_id * 7919 % 1000 * 3 AS DOUBLE) ELSE 0.0::DOUBLE END
    ELSE floor(value * (CASE ((epoch - 1) // 15) % 5 WHEN 0 THEN 5.0 WHEN 1 THEN 30.0 WHEN 2 THEN 150.0 WHEN 3 THEN 20.0
    WHEN 4 THEN 60.0 END)::DOUBLE) END AS axis1
  FROM e0),
e AS (
  SELECT subject, epoch, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(epoch - 1) AS timestamp,
    DATE '2024-01-01' + CAST((epoch - 1) // 1440 AS INTEGER) AS date, CAST(((epoch - 1) % 1440) // 60 AS INTEGER) AS hour, axis1,
    floor(axis1 * 0.5::DOUBLE + h % 50) AS axis2, floor(axis1 * 0.25::DOUBLE + h % 30) AS axis3, floor(axis1 / 50) AS steps,
    sqrt(axis1 * axis1 + pow(floor(axis1 * 0.5::DOUBLE + h % 50), 2) + pow(floor(axis1 * 0.25::DOUBLE + h % 30), 2)) AS vm
  FROM e1),
r AS (
  SELECT subject, epoch AS sample, timestamp,
    0.02::DOUBLE + CASE WHEN axis1 > 500 THEN axis1 / 10000 ELSE 0 END * (epoch % 3) AS x,
    1.01::DOUBLE + CASE WHEN axis1 > 500 THEN axis1 / 10000 ELSE 0 END * (epoch % 5 - 2) AS y,
    0.01::DOUBLE - CASE WHEN axis1 > 500 THEN axis1 / 10000 ELSE 0 END * (epoch % 2) AS z
  FROM e)
