-- with epochs, wear_choi, rich, batch_rows, batch_table
SELECT count(*) AS n_subjects, round((avg(total_mvpa))::DOUBLE, 6) AS mean_total_mvpa,
  round((avg(sedentary))::DOUBLE, 6) AS mean_sedentary, round((avg(mvpa_per_day))::DOUBLE, 6) AS mean_mvpa_per_day
FROM bt
