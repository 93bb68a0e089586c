-- with epochs, wear_choi, rich
SELECT s.subject, l.intensity, count(d.epoch)::DOUBLE AS minutes,
  round((100.0 * count(d.epoch) / any_value(s.total))::DOUBLE, 6) AS percent
FROM (
  SELECT subject, count(*) AS total
  FROM d
  WHERE wear_time
  GROUP BY subject) s
CROSS JOIN (
  SELECT unnest(['sedentary', 'light', 'moderate', 'vigorous', 'very_vigorous']) AS intensity) l
LEFT JOIN d ON d.subject = s.subject AND d.intensity = l.intensity AND d.wear_time
GROUP BY s.subject, l.intensity
