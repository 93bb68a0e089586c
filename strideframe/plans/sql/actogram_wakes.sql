-- with epochs, cole_kripke, plain_states, sleep_periods
y AS (
  SELECT x.*, sp.period_number, sp.ib,
    x.epoch - row_number() OVER (PARTITION BY x.subject, x.start_index, x.sw ORDER BY x.epoch) AS g
  FROM x
  JOIN sp ON sp.subject = x.subject AND sp.start_index = x.start_index),
z2 AS (
  SELECT subject, period_number, min(epoch) AS start_index, max(epoch) AS end_index,
    min(date_diff('minute', ib, timestamp))::DOUBLE AS start_minutes, max(date_diff('minute', ib, timestamp))::DOUBLE AS end_minutes,
    any_value(start_index) AS a, any_value(last_index) AS b
  FROM y
  WHERE sw = 'W'
  GROUP BY subject, period_number, g
  HAVING count(*) >= 2)
SELECT subject, period_number, start_index, end_index, start_minutes, end_minutes
FROM z2
WHERE start_index > a AND end_index < b
