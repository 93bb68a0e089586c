-- with epochs, wear_choi, rich
SELECT subject, hour::BIGINT AS hour, count(*) FILTER (WHERE s)::DOUBLE AS sedentary_min,
  count(*) FILTER (WHERE before AND NOT s) AS breaks, count(*) FILTER (WHERE wear_time)::DOUBLE AS wear_min,
  round((CASE WHEN count(*) FILTER (WHERE s) > 0 THEN count(*) FILTER (WHERE before
  AND NOT s) / (count(*) FILTER (WHERE s) / 60.0) ELSE 0 END)::DOUBLE, 6) AS breaks_per_sed_hour
FROM (
  SELECT *, coalesce(lag(s) OVER (PARTITION BY subject ORDER BY epoch), FALSE) AS before
  FROM (
    SELECT *, coalesce(intensity = 'sedentary' AND wear_time, FALSE) AS s
    FROM d))
GROUP BY subject, hour
