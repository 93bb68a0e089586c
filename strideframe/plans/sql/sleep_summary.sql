-- with epochs, cole_kripke, plain_states, sleep_periods
SELECT t.*, coalesce(n_periods, 0) AS n_periods, coalesce(tst, 0)::DOUBLE AS total_sleep_time,
  round((coalesce(me, 0))::DOUBLE, 6) AS mean_efficiency, round((coalesce(ma, 0))::DOUBLE, 6) AS mean_awakenings
FROM (
  SELECT subject, count(*) AS total_epochs, count(*) FILTER (WHERE sw = 'S') AS sleep_epochs,
    count(*) FILTER (WHERE sw = 'W') AS wake_epochs
  FROM ck
  GROUP BY subject) t
LEFT JOIN (
  SELECT subject, count(*) AS n_periods, sum(sleep_time) AS tst, avg(se) AS me, avg(number_of_awakenings) AS ma
  FROM sp
  GROUP BY subject) USING (subject)
