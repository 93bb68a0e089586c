-- with epochs, wear_choi, rich
SELECT subject, strftime(date, '%Y-%m-%d') AS date, sum(axis1) AS counts, sum(steps) AS steps,
  count(*) FILTER (WHERE coalesce(intensity IN ('moderate', 'vigorous', 'very_vigorous'), FALSE)) AS mvpa_minutes,
  count(*) FILTER (WHERE intensity = 'sedentary') AS sedentary_minutes
FROM d
GROUP BY subject, date
