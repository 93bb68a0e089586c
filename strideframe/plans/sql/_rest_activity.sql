hm AS (
  SELECT subject, hour, avg(CASE WHEN wear_time THEN axis1 END) AS m
  FROM d
  GROUP BY ALL),
l5w AS (
  SELECT subject, (hour - i + 24) % 24 AS start, avg(m) AS v
  FROM hm
  CROSS JOIN (
    SELECT unnest(range(5)) AS i)
  GROUP BY ALL
  HAVING avg(m) IS NOT NULL),
l5t AS (
  SELECT subject, v AS l5, printf('%02d:00', start::INT) AS l5_start
  FROM (
    SELECT *, row_number() OVER (PARTITION BY subject ORDER BY v, start) AS k
    FROM l5w)
  WHERE k = 1),
m10w AS (
  SELECT subject, (hour - i + 24) % 24 AS start, avg(m) AS v
  FROM hm
  CROSS JOIN (
    SELECT unnest(range(10)) AS i)
  GROUP BY ALL
  HAVING avg(m) IS NOT NULL),
m10t AS (
  SELECT subject, v AS m10, printf('%02d:00', start::INT) AS m10_start
  FROM (
    SELECT *, row_number() OVER (PARTITION BY subject ORDER BY -v, start) AS k
    FROM m10w)
  WHERE k = 1)
