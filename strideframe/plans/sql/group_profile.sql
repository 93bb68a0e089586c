-- with epochs, wear_choi, rich
SELECT hour::BIGINT AS hour, round((avg(m))::DOUBLE, 6) AS mean_activity, count(m) AS n_subjects
FROM (
  SELECT subject, hour, avg(CASE WHEN wear_time THEN axis1 END) AS m
  FROM d
  GROUP BY ALL)
GROUP BY hour
