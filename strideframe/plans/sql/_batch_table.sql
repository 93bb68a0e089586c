bt AS (
  SELECT subject, valid_days, sedentary, light, moderate, vigorous, very_vigorous, n_epochs,
    round((axis1_counts)::DOUBLE, 6) AS axis1_counts, round((axis1_average)::DOUBLE, 6) AS axis1_average,
    round((axis1_max)::DOUBLE, 6) AS axis1_max, round((axis2_counts)::DOUBLE, 6) AS axis2_counts,
    round((axis2_average)::DOUBLE, 6) AS axis2_average, round((axis2_max)::DOUBLE, 6) AS axis2_max,
    round((axis3_counts)::DOUBLE, 6) AS axis3_counts, round((axis3_average)::DOUBLE, 6) AS axis3_average,
    round((axis3_max)::DOUBLE, 6) AS axis3_max, round((vm_counts)::DOUBLE, 6) AS vm_counts,
    round((vm_average)::DOUBLE, 6) AS vm_average, round((vm_max)::DOUBLE, 6) AS vm_max,
    round((steps_counts)::DOUBLE, 6) AS steps_counts, round((steps_average)::DOUBLE, 6) AS steps_average,
    round((steps_max)::DOUBLE, 6) AS steps_max, total_mvpa, round((100 * sedentary / n_epochs)::DOUBLE, 6) AS sedentary_percent,
    round((100 * light / n_epochs)::DOUBLE, 6) AS light_percent,
    round((100 * moderate / n_epochs)::DOUBLE, 6) AS moderate_percent,
    round((100 * vigorous / n_epochs)::DOUBLE, 6) AS vigorous_percent,
    round((100 * very_vigorous / n_epochs)::DOUBLE, 6) AS very_vigorous_percent,
    round((100 * total_mvpa / n_epochs)::DOUBLE, 6) AS total_mvpa_percent,
    round((total_mvpa / greatest(valid_days, 1))::DOUBLE, 6) AS mvpa_per_day
  FROM rq
  JOIN vd USING (subject))
