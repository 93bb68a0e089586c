-- with epochs
SELECT subject, tp, tn, fp, fn, round((tp / nullif(tp + fn, 0))::DOUBLE, 6) AS sensitivity,
  round((tn / nullif(tn + fp, 0))::DOUBLE, 6) AS specificity,
  round(((tp + tn) / nullif(tp + tn + fp + fn, 0))::DOUBLE, 6) AS accuracy,
  round((tp / nullif(tp + fp, 0))::DOUBLE, 6) AS precision, round((2 * tp / nullif(2 * tp + fp + fn, 0))::DOUBLE, 6) AS f1
FROM (
  SELECT subject, count(*) FILTER (WHERE p AND a) AS tp, count(*) FILTER (WHERE NOT p AND NOT a) AS tn,
    count(*) FILTER (WHERE p AND NOT a) AS fp, count(*) FILTER (WHERE NOT p AND a) AS fn
  FROM (
    SELECT subject, vm > 2000 AS p, axis1 > 1951 AS a
    FROM e)
  GROUP BY subject)
