-- with epochs, wear_choi, rich
SELECT subject, count(DISTINCT date) AS n_days,
  round((count(*) FILTER (WHERE intensity IN ('sedentary')) / count(DISTINCT date))::DOUBLE, 6) AS sedentary,
  round((count(*) FILTER (WHERE intensity IN ('light')) / count(DISTINCT date))::DOUBLE, 6) AS light,
  round((count(*) FILTER (WHERE intensity IN ('moderate')) / count(DISTINCT date))::DOUBLE, 6) AS moderate,
  round((count(*) FILTER (WHERE intensity IN ('vigorous', 'very_vigorous')) / count(DISTINCT date))::DOUBLE, 6) AS vigorous
FROM d
WHERE wear_time
GROUP BY subject
