-- with epochs, wear_choi, rich, sedentary_bouts
SELECT s.subject, c.category, count(sb.duration) AS n_bouts,
  round((100.0 * count(sb.duration) / any_value(s.n))::DOUBLE, 6) AS percent
FROM (
  SELECT subject, count(*) AS n
  FROM sb
  GROUP BY subject) s
CROSS JOIN (
  SELECT unnest(['1-5 min', '5-10 min', '10-20 min', '20-30 min', '30-60 min', '>60 min']) AS category) c
LEFT JOIN sb ON sb.subject = s.subject AND CASE WHEN duration <= 5 THEN '1-5 min' WHEN duration <= 10 THEN '5-10 min'
  WHEN duration <= 20 THEN '10-20 min' WHEN duration <= 30 THEN '20-30 min' WHEN duration <= 60 THEN '30-60 min'
  ELSE '>60 min' END = c.category
GROUP BY s.subject, c.category
