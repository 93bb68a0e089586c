-- with epochs, wear_choi, rich, sedentary_bouts
t AS (
  SELECT subject, count(*) FILTER (WHERE intensity = 'sedentary' AND wear_time)::DOUBLE AS total_sedentary_min,
    count(*) FILTER (WHERE wear_time)::DOUBLE AS total_wear_min, count(DISTINCT date) AS n_days,
    arg_max(coalesce(intensity = 'sedentary' AND wear_time, FALSE), epoch) AS ends
  FROM d
  GROUP BY subject),
f AS (
  SELECT subject, count(*) AS total_bouts, avg(duration) AS mean_d, median(duration) AS median_d,
    max(duration) AS max_bout_duration
  FROM sb
  GROUP BY subject)
SELECT t.subject, total_sedentary_min, total_wear_min, n_days, coalesce(total_bouts, 0) AS total_bouts,
  round((mean_d)::DOUBLE, 6) AS mean_bout_duration, round((median_d)::DOUBLE, 6) AS median_bout_duration, max_bout_duration,
  round((alpha)::DOUBLE, 6) AS alpha, round((gini)::DOUBLE, 6) AS gini,
  CASE WHEN total_bouts > 1 OR (total_bouts = 1 AND NOT ends) THEN total_bouts ELSE 0 END AS breaks_total,
  round((CASE WHEN total_bouts > 1 OR (total_bouts = 1 AND NOT ends) THEN total_bouts
  ELSE 0 END / (total_sedentary_min / 60))::DOUBLE, 6) AS breaks_per_sed_hour,
  round((100 * total_sedentary_min / total_wear_min)::DOUBLE, 6) AS sedentary_percent
FROM t
LEFT JOIN f USING (subject)
LEFT JOIN (
  SELECT subject, CASE WHEN count(*) > 1
    AND sum(duration) <> 0 THEN (2 * sum(i * duration) - (count(*) + 1) * sum(duration)) / (count(*) * sum(duration)) END AS gini
  FROM (
    SELECT *, row_number() OVER (PARTITION BY subject ORDER BY duration, start_index) AS i
    FROM sb)
  GROUP BY subject) USING (subject)
LEFT JOIN (
  SELECT subject, CASE WHEN count(*) > 1 AND sum(ln(duration)) > 0 THEN 1 + count(*) / sum(ln(duration)) END AS alpha
  FROM sb
  GROUP BY subject) USING (subject)
