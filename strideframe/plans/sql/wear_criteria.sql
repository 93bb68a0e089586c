-- with epochs, wear_choi, rich
days AS (
  SELECT subject, date, count(*) AS n, sum(wear_time::INT)::BIGINT AS wear_epochs
  FROM d
  GROUP BY ALL),
periods AS (
  SELECT subject, wear_time, count(*) * 60 AS seconds
  FROM (
    SELECT *, epoch - row_number() OVER (PARTITION BY subject, wear_time ORDER BY epoch) AS g
    FROM d)
  GROUP BY subject, wear_time, g),
a AS (
  SELECT subject, count(*) FILTER (WHERE wear_epochs >= 600) AS valid_days,
    count(*) FILTER (WHERE wear_epochs >= 600 AND isodow(date) < 6) AS valid_weekdays,
    count(*) FILTER (WHERE wear_epochs >= 600 AND isodow(date) >= 6) AS valid_weekend_days,
    count(*) AS total_days, round((100.0 * sum(wear_epochs) / sum(n))::DOUBLE, 6) AS wear_percent
  FROM days
  GROUP BY subject),
b AS (
  SELECT subject, count(*) FILTER (WHERE wear_time) AS wear_periods,
    round(coalesce(avg(seconds) FILTER (WHERE wear_time), 0)::DOUBLE, 6) AS mean_wear_seconds,
    count(*) FILTER (WHERE NOT wear_time AND seconds >= 5400) AS non_wear_periods,
    round(coalesce(avg(seconds) FILTER (WHERE NOT wear_time AND seconds >= 5400), 0)::DOUBLE, 6) AS mean_non_wear_seconds
  FROM periods
  GROUP BY subject)
SELECT *, valid_days >= 4 AND valid_weekdays >= 3 AND valid_weekend_days >= 1 AS meets_criteria
FROM a
JOIN b USING (subject)
