-- with epochs
SELECT subject, epoch, round((CASE WHEN cpe <= 8 THEN 1.0::DOUBLE WHEN cv <= 10 THEN 2.294275 * exp(0.00084679 * cpe)
  ELSE 0.749395 + 0.716431 * ln(cpe) - 0.179874 * pow(ln(cpe), 2) + 0.033173 * pow(ln(cpe), 3) END)::DOUBLE, 6) AS mets
FROM (
  SELECT *, CASE WHEN n < 3 THEN 100 WHEN m > 0 THEN s / m * 100 ELSE 0 END AS cv
  FROM (
    SELECT subject, epoch, axis1 / 6 AS cpe, avg(axis1 / 6) OVER f AS m, stddev_samp(axis1 / 6) OVER f AS s, count(*) OVER f AS n
    FROM e
    WINDOW f AS (PARTITION BY subject ORDER BY epoch ROWS BETWEEN 2 PRECEDING AND 3 FOLLOWING)))
