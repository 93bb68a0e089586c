-- with epochs, wear_choi, rich
SELECT subject, intensity, round((total_kcal)::DOUBLE, 6) AS total_kcal,
  round((100 * total_kcal / whole)::DOUBLE, 6) AS percent_kcal
FROM (
  SELECT *, sum(total_kcal) OVER (PARTITION BY subject) AS whole
  FROM (
    SELECT subject, intensity, sum(kcal) AS total_kcal
    FROM d
    WHERE wear_time
    GROUP BY subject, intensity))
WHERE intensity IS NOT NULL
