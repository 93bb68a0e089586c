-- with epochs, wear_choi, rich, sedentary_bouts
SELECT subject, round((gini)::DOUBLE, 6) AS gini
FROM (
  SELECT subject, CASE WHEN count(*) > 1
    AND sum(duration) <> 0 THEN (2 * sum(i * duration) - (count(*) + 1) * sum(duration)) / (count(*) * sum(duration)) END AS gini
  FROM (
    SELECT *, row_number() OVER (PARTITION BY subject ORDER BY duration, start_index) AS i
    FROM sb)
  GROUP BY subject)
