-- with epochs, wear_choi, rich
SELECT subject, count(*) AS n_days, count(*) FILTER (WHERE h >= 10) AS valid_days, round((sum(h))::DOUBLE, 6) AS wear_hours,
  round((avg(h))::DOUBLE, 6) AS mean_wear_hours
FROM (
  SELECT subject, date, count(*) FILTER (WHERE wear_time) / 60 AS h
  FROM d
  GROUP BY ALL)
GROUP BY subject
