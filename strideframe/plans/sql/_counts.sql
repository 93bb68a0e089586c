v AS (
  SELECT subject, axis, sample AS i, v, first_value(v) OVER o AS v0, -0.00934::DOUBLE * v - 0.0255::DOUBLE * coalesce(lag(v, 1) OVER o, first_value(v) OVER o)
    - 0.00424::DOUBLE * coalesce(lag(v, 2) OVER o, first_value(v) OVER o) + 0.0442::DOUBLE * coalesce(lag(v, 3) OVER o, first_value(v) OVER o)
    + 0.0365::DOUBLE * coalesce(lag(v, 4) OVER o, first_value(v) OVER o) - 0.0119::DOUBLE * coalesce(lag(v, 5) OVER o, first_value(v) OVER o)
    - 0.0229::DOUBLE * coalesce(lag(v, 6) OVER o, first_value(v) OVER o) - 0.00679::DOUBLE * coalesce(lag(v, 7) OVER o, first_value(v) OVER o) AS u
  FROM (
    SELECT subject, sample, unnest([1, 2, 3]) AS axis, unnest([y, x, z]) AS v
    FROM r)
  WINDOW o AS (PARTITION BY subject, axis ORDER BY sample)),
filtered AS (
  SELECT subject, axis, 0::BIGINT AS i, y1, y1 AS y2, y1 AS y3, y1 AS y4, y1 AS y5, y1 AS y6, y1 AS y7
  FROM (
    SELECT subject, axis, v0 * (-0.00934::DOUBLE - 0.0255 - 0.00424 + 0.0442 + 0.0365 - 0.0119 - 0.0229 - 0.00679)
      / (1::DOUBLE - 3.63 + 5.04 - 3.10 + 0.506 + 0.324 - 0.157 + 0.0195) AS y1
    FROM v
    WHERE i = 1)
  UNION ALL
  SELECT f.subject, f.axis, f.i + 1, v.u + 3.63::DOUBLE * y1 - 5.04::DOUBLE * y2 + 3.10::DOUBLE * y3 - 0.506::DOUBLE * y4
    - 0.324::DOUBLE * y5 + 0.157::DOUBLE * y6 - 0.0195::DOUBLE * y7, y1, y2, y3, y4, y5, y6
  FROM filtered f
  JOIN v ON v.subject = f.subject AND v.axis = f.axis AND v.i = f.i + 1),
limited AS (
  SELECT subject, axis, i, CASE WHEN a < 4 THEN 0 ELSE a END AS a
  FROM (
    SELECT subject, axis, i, least(abs(y1 * 17.127404), 128) AS a
    FROM filtered
    WHERE i > 0)),
tens AS (
  SELECT subject, axis, (i - 1) // 3 AS t, floor(sum(a) / 3) AS n
  FROM limited
  GROUP BY ALL
  HAVING count(*) = 3),
sums AS (
  SELECT subject, axis, t // 50 + 1 AS epoch, sum(n) AS n
  FROM tens
  GROUP BY ALL
  HAVING count(*) = 50),
cnt AS (
  SELECT subject, epoch, max(n) FILTER (WHERE axis = 1) AS axis1, max(n) FILTER (WHERE axis = 2) AS axis2, max(n) FILTER (WHERE axis = 3) AS axis3
  FROM sums
  GROUP BY subject, epoch)
