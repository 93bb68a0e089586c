s AS (
  SELECT *, (sw = 'S')::INT AS s, max(epoch) OVER (PARTITION BY subject) AS n
  FROM states),
q AS (
  SELECT *, sum(s) OVER (PARTITION BY subject ORDER BY epoch ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) = 5
    AND epoch + 4 <= n AS starts, sum(s) OVER (PARTITION BY subject ORDER BY epoch ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) = 0
    AND epoch + 9 <= n AS wakes
  FROM s),
v AS (
  SELECT subject, epoch, starts, min(CASE
    WHEN wakes THEN epoch END) OVER (PARTITION BY subject ORDER BY epoch ROWS BETWEEN 5 FOLLOWING AND UNBOUNDED FOLLOWING) AS wake
  FROM q),
p AS (
  SELECT v.subject, wake - 1 AS last_index, min(epoch) AS start_index
  FROM v
  WHERE starts AND wake - epoch >= 60 AND wake - epoch < 1440 AND (
    SELECT sum(q.s)
    FROM q
    WHERE q.subject = v.subject AND q.epoch >= v.epoch AND q.epoch < v.wake) >= 15
  GROUP BY v.subject, wake),
x AS (
  SELECT p.subject, p.start_index, p.last_index, q.epoch, q.timestamp, q.sw, q.axis1,
    q.sw = 'W' AND lag(q.sw) OVER (PARTITION BY p.subject, p.start_index ORDER BY q.epoch) IS DISTINCT
  FROM 'W' AS nw
  FROM p
  JOIN q ON q.subject = p.subject AND q.epoch BETWEEN p.start_index AND p.last_index),
m AS (
  SELECT subject, start_index, max(epoch) AS last_index, min(timestamp) AS ib, max(timestamp) AS ob,
    min(CASE WHEN sw = 'S' THEN timestamp END) AS os, count(*) FILTER (WHERE sw = 'S') AS sleep_time,
    count(*) FILTER (WHERE sw = 'W') AS wake_time, count(*) FILTER (WHERE nw) AS number_of_awakenings, count(*) AS total,
    sum(axis1) AS total_counts
  FROM x
  GROUP BY subject, start_index),
z AS (
  SELECT *, CASE WHEN number_of_awakenings > 0 THEN wake_time / number_of_awakenings ELSE 0 END AS aa,
    100.0 * wake_time / total AS mi, (number_of_awakenings + 100.0 * wake_time / total) / total AS fi,
    100.0 * sleep_time / total AS se
  FROM m),
sp AS (
  SELECT *, row_number() OVER (PARTITION BY subject ORDER BY start_index) AS period_number
  FROM z
  WHERE NOT (sleep_time > 720 AND se > 99 AND number_of_awakenings = 0))
