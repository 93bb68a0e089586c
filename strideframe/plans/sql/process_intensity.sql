-- with epochs, counts, processed
SELECT s.subject, l.intensity, round(count(p.epoch) * 5 / 60::DOUBLE, 6) AS minutes,
  round(100.0::DOUBLE * count(p.epoch) / any_value(s.total), 6) AS percent
FROM (
  SELECT subject, count(*) AS total
  FROM p
  WHERE wear_time
  GROUP BY subject) s
CROSS JOIN (
  SELECT unnest(['sedentary', 'light', 'moderate', 'vigorous', 'very_vigorous']) AS intensity) l
LEFT JOIN p ON p.subject = s.subject AND p.intensity = l.intensity AND p.wear_time
GROUP BY s.subject, l.intensity
