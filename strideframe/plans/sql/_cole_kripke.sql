ck AS (
  SELECT *, CASE WHEN 0.001 * (106 * coalesce(lag(c, 4) OVER (PARTITION BY subject ORDER BY epoch),
    0) + 54 * coalesce(lag(c, 3) OVER (PARTITION BY subject ORDER BY epoch),
    0) + 58 * coalesce(lag(c, 2) OVER (PARTITION BY subject ORDER BY epoch),
    0) + 76 * coalesce(lag(c, 1) OVER (PARTITION BY subject ORDER BY epoch),
    0) + 230 * c + 74 * coalesce(lead(c, 1) OVER (PARTITION BY subject ORDER BY epoch),
    0) + 67 * coalesce(lead(c, 2) OVER (PARTITION BY subject ORDER BY epoch), 0)) < 1 THEN 'S' ELSE 'W' END AS sw
  FROM (
    SELECT *, least(axis1 / 100, 300) AS c
    FROM e))
