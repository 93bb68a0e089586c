-- with epochs, wear_choi, rich, sedentary_bouts
SELECT subject, round((alpha)::DOUBLE, 6) AS alpha
FROM (
  SELECT subject, CASE WHEN count(*) > 1 AND sum(ln(duration)) > 0 THEN 1 + count(*) / sum(ln(duration)) END AS alpha
  FROM sb
  GROUP BY subject)
