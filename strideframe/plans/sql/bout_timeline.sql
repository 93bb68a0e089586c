-- with epochs, wear_choi, rich, sedentary_bouts
SELECT subject, row_number() OVER (PARTITION BY subject ORDER BY start_index) AS bout_id, left(start_time, 10) AS date,
  round((substr(start_time, 12, 2)::INT + substr(start_time, 15, 2)::INT / 60.0::DOUBLE)::DOUBLE, 6) AS start_hour,
  round((substr(end_time, 12, 2)::INT + substr(end_time, 15, 2)::INT / 60.0::DOUBLE)::DOUBLE, 6) AS end_hour, duration
FROM sb
