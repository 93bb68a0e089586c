-- with epochs, wear_choi, rich
hm AS (
  SELECT subject, date, hour, avg(CASE WHEN wear_time THEN axis1 END) AS m
  FROM d
  GROUP BY ALL),
l5w AS (
  SELECT subject, date, (hour - i + 24) % 24 AS start, avg(m) AS v
  FROM hm
  CROSS JOIN (
    SELECT unnest(range(5)) AS i)
  GROUP BY ALL
  HAVING avg(m) IS NOT NULL),
l5t AS (
  SELECT subject, date, v AS l5, printf('%02d:00', start::INT) AS l5_start
  FROM (
    SELECT *, row_number() OVER (PARTITION BY subject, date ORDER BY v, start) AS k
    FROM l5w)
  WHERE k = 1),
m10w AS (
  SELECT subject, date, (hour - i + 24) % 24 AS start, avg(m) AS v
  FROM hm
  CROSS JOIN (
    SELECT unnest(range(10)) AS i)
  GROUP BY ALL
  HAVING avg(m) IS NOT NULL),
m10t AS (
  SELECT subject, date, v AS m10, printf('%02d:00', start::INT) AS m10_start
  FROM (
    SELECT *, row_number() OVER (PARTITION BY subject, date ORDER BY -v, start) AS k
    FROM m10w)
  WHERE k = 1),
k AS (
  SELECT subject, date, count(CASE WHEN wear_time THEN axis1 END) >= 720 AS ok
  FROM d
  GROUP BY ALL)
SELECT subject, strftime(date, '%Y-%m-%d') AS date, round((CASE WHEN ok THEN l5 END)::DOUBLE, 6) AS l5,
  CASE WHEN ok THEN l5_start END AS l5_start, round((CASE WHEN ok THEN m10 END)::DOUBLE, 6) AS m10,
  CASE WHEN ok THEN m10_start END AS m10_start,
  round((CASE WHEN ok AND m10 + l5 <> 0 THEN (m10 - l5) / (m10 + l5) END)::DOUBLE, 6) AS ra
FROM k
LEFT JOIN l5t USING (subject, date)
LEFT JOIN m10t USING (subject, date)
