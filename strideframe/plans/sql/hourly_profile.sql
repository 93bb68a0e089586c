-- with epochs, wear_choi, rich
SELECT s.subject, h.hour, round((avg(CASE WHEN wear_time THEN axis1 END))::DOUBLE, 6) AS mean_activity,
  round((stddev_samp(CASE WHEN wear_time THEN axis1 END))::DOUBLE, 6) AS sd_activity,
  count(CASE WHEN wear_time THEN axis1 END) AS n
FROM (
  SELECT DISTINCT subject
  FROM d) s
CROSS JOIN (
  SELECT unnest(range(24)) AS hour) h
LEFT JOIN d ON d.subject = s.subject AND d.hour = h.hour
GROUP BY s.subject, h.hour
