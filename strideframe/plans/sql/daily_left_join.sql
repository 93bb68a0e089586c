-- with epochs, wear_choi, rich
SELECT a.subject, strftime(a.date, '%Y-%m-%d') AS date, wear_minutes, is_valid, sedentary_min, light_min, moderate_min,
  vigorous_min, very_vigorous_min, round((mean_cpm)::DOUBLE, 6) AS mean_cpm, round((mean_mets)::DOUBLE, 6) AS mean_mets,
  round((total_kcal)::DOUBLE, 6) AS total_kcal
FROM (
  SELECT subject, date, count(*) FILTER (WHERE wear_time)::DOUBLE AS wear_minutes, max(is_valid_day) AS is_valid
  FROM d
  GROUP BY ALL) a
LEFT JOIN (
  SELECT subject, date, count(*) FILTER (WHERE intensity = 'sedentary')::DOUBLE AS sedentary_min,
    count(*) FILTER (WHERE intensity = 'light')::DOUBLE AS light_min,
    count(*) FILTER (WHERE intensity = 'moderate')::DOUBLE AS moderate_min,
    count(*) FILTER (WHERE intensity = 'vigorous')::DOUBLE AS vigorous_min,
    count(*) FILTER (WHERE intensity = 'very_vigorous')::DOUBLE AS very_vigorous_min, avg(cpm) AS mean_cpm,
    avg(mets) AS mean_mets, sum(kcal) AS total_kcal
  FROM d
  WHERE wear_time
  GROUP BY ALL) b ON a.subject = b.subject AND a.date = b.date
