-- with epochs, cole_kripke, plain_states, sleep_periods
SELECT x.subject, period_number, epoch, date_diff('minute', ib, timestamp)::DOUBLE AS minutes, sw AS sleep_wake,
  round((coalesce(axis1 / nullif(max(axis1) OVER (PARTITION BY x.subject, period_number), 0), 0))::DOUBLE, 6) AS activity
FROM x
JOIN sp ON sp.subject = x.subject AND sp.start_index = x.start_index
