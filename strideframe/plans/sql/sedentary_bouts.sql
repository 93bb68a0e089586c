-- with epochs, wear_choi, rich, sedentary_bouts
SELECT *, row_number() OVER (PARTITION BY subject ORDER BY start_index) AS bout_id
FROM sb
