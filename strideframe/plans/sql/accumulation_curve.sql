-- with epochs, wear_choi, rich, sedentary_bouts
SELECT subject, start_index, duration, row_number() OVER o AS rank,
  round((100 * sum(duration) OVER o / sum(duration) OVER (PARTITION BY subject))::DOUBLE, 6) AS time_percent,
  round((100.0 * row_number() OVER o / count(*) OVER (PARTITION BY subject))::DOUBLE, 6) AS bout_percent
FROM sb
WINDOW o AS (PARTITION BY subject ORDER BY duration DESC, start_index)
