-- with epochs, wear_choi, rich, rest_activity
SELECT count(*) AS n_subjects, round((avg(l5))::DOUBLE, 6) AS mean_l5, round((avg(m10))::DOUBLE, 6) AS mean_m10,
  round((avg(CASE WHEN m10 + l5 <> 0 THEN (m10 - l5) / (m10 + l5) END))::DOUBLE, 6) AS mean_ra
FROM l5t
JOIN m10t USING (subject)
