-- with epochs, wear_choi, rich, mvpa_bouts
SELECT *, round((100.0 * mvpa_minutes / bout_length)::DOUBLE, 6) AS mvpa_percent,
  row_number() OVER (PARTITION BY subject ORDER BY start_index) AS bout_number
FROM b4
