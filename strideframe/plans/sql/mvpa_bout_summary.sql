-- with epochs, wear_choi, rich, mvpa_bouts
SELECT subject, count(*) AS total_bouts, sum(bout_length)::BIGINT AS total_bout_minutes,
  round((avg(bout_length))::DOUBLE, 6) AS mean_bout_length, round((median(bout_length))::DOUBLE, 6) AS median_bout_length,
  min(bout_length) AS min_bout_length, max(bout_length) AS max_bout_length
FROM b4
GROUP BY subject
