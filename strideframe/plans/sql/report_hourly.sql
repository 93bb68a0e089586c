-- with epochs, wear_choi, rich, hourly_rows
SELECT subject, strftime(date, '%Y-%m-%d') AS date, hour::BIGINT AS hour, calendar_days,
  CASE WHEN v THEN sedentary ELSE 0 END AS sedentary, CASE WHEN v THEN light ELSE 0 END AS light,
  CASE WHEN v THEN moderate ELSE 0 END AS moderate, CASE WHEN v THEN vigorous ELSE 0 END AS vigorous,
  CASE WHEN v THEN very_vigorous ELSE 0 END AS very_vigorous, CASE WHEN v THEN n_epochs ELSE 0 END AS n_epochs,
  CASE WHEN v THEN total_mvpa ELSE 0 END AS total_mvpa,
  round((CASE WHEN v THEN axis1_counts ELSE 0 END)::DOUBLE, 6) AS axis1_counts,
  round((CASE WHEN v THEN axis1_average ELSE 0 END)::DOUBLE, 6) AS axis1_average,
  round((CASE WHEN v THEN axis1_max ELSE 0 END)::DOUBLE, 6) AS axis1_max,
  round((CASE WHEN v THEN axis2_counts ELSE 0 END)::DOUBLE, 6) AS axis2_counts,
  round((CASE WHEN v THEN axis2_average ELSE 0 END)::DOUBLE, 6) AS axis2_average,
  round((CASE WHEN v THEN axis2_max ELSE 0 END)::DOUBLE, 6) AS axis2_max,
  round((CASE WHEN v THEN axis3_counts ELSE 0 END)::DOUBLE, 6) AS axis3_counts,
  round((CASE WHEN v THEN axis3_average ELSE 0 END)::DOUBLE, 6) AS axis3_average,
  round((CASE WHEN v THEN axis3_max ELSE 0 END)::DOUBLE, 6) AS axis3_max,
  round((CASE WHEN v THEN vm_counts ELSE 0 END)::DOUBLE, 6) AS vm_counts,
  round((CASE WHEN v THEN vm_average ELSE 0 END)::DOUBLE, 6) AS vm_average,
  round((CASE WHEN v THEN vm_max ELSE 0 END)::DOUBLE, 6) AS vm_max,
  round((CASE WHEN v THEN steps_counts ELSE 0 END)::DOUBLE, 6) AS steps_counts,
  round((CASE WHEN v THEN steps_average ELSE 0 END)::DOUBLE, 6) AS steps_average,
  round((CASE WHEN v THEN steps_max ELSE 0 END)::DOUBLE, 6) AS steps_max,
  round((CASE WHEN v THEN 100 * sedentary / n_epochs ELSE 0 END)::DOUBLE, 6) AS sedentary_percent,
  round((CASE WHEN v THEN 100 * light / n_epochs ELSE 0 END)::DOUBLE, 6) AS light_percent,
  round((CASE WHEN v THEN 100 * moderate / n_epochs ELSE 0 END)::DOUBLE, 6) AS moderate_percent,
  round((CASE WHEN v THEN 100 * vigorous / n_epochs ELSE 0 END)::DOUBLE, 6) AS vigorous_percent,
  round((CASE WHEN v THEN 100 * very_vigorous / n_epochs ELSE 0 END)::DOUBLE, 6) AS very_vigorous_percent,
  round((CASE WHEN v THEN 100 * total_mvpa / n_epochs ELSE 0 END)::DOUBLE, 6) AS total_mvpa_percent,
  round((CASE WHEN v THEN total_mvpa / (n_epochs / 60) ELSE 0 END)::DOUBLE, 6) AS mvpa_per_hour
FROM rq
JOIN (
  SELECT DISTINCT subject AS s, date AS dd, is_valid_day AS v
  FROM d) ON s = subject AND dd = date
