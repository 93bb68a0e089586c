-- with epochs
m AS (
  SELECT subject, (sample - 1) // 10 AS w, avg(x) AS mx, avg(y) AS my, avg(z) AS mz
  FROM r
  GROUP BY subject, w
  HAVING count(*) = 10 AND stddev_samp(x) < 0.013 AND stddev_samp(y) < 0.013 AND stddev_samp(z) < 0.013),
descent AS (
  SELECT subject, 0 AS i, 0.0::DOUBLE AS ox, 0.0::DOUBLE AS oy, 0.0::DOUBLE AS oz, FALSE AS done
  FROM m
  GROUP BY subject
  HAVING count(*) >= 10
  UNION ALL
  SELECT subject, i + 1, ox + sx, oy + sy, oz + sz, greatest(abs(sx), abs(sy), abs(sz)) < 1e-6
  FROM (
    SELECT subject, i, any_value(ox) AS ox, any_value(oy) AS oy, any_value(oz) AS oz,
      0.2::DOUBLE * avg((n - 1) / n * (mx - ox)) AS sx, 0.2::DOUBLE * avg((n - 1) / n * (my - oy)) AS sy,
      0.2::DOUBLE * avg((n - 1) / n * (mz - oz)) AS sz
    FROM (
      SELECT d.subject, d.i, ox, oy, oz, mx, my, mz, sqrt(pow(mx - ox, 2) + pow(my - oy, 2) + pow(mz - oz, 2)) AS n
      FROM descent d
      JOIN m ON m.subject = d.subject
      WHERE NOT d.done AND d.i < 1000)
    GROUP BY subject, i)),
o AS (
  SELECT subject, arg_max(ox, i) AS ox, arg_max(oy, i) AS oy, arg_max(oz, i) AS oz
  FROM descent
  GROUP BY subject),
e2 AS (
  SELECT m.subject, count(*) AS n_windows, any_value(ox) AS ox, any_value(oy) AS oy, any_value(oz) AS oz,
    avg(abs(sqrt(mx * mx + my * my + mz * mz) - 1)) AS before,
    avg(abs(sqrt(pow(mx - ox, 2) + pow(my - oy, 2) + pow(mz - oz, 2)) - 1)) AS after
  FROM m
  LEFT JOIN o ON o.subject = m.subject
  GROUP BY m.subject)
SELECT s.subject, round(coalesce(ox, 0), 6) AS offset_x, round(coalesce(oy, 0), 6) AS offset_y, round(coalesce(oz, 0), 6) AS offset_z,
  coalesce(n_windows, 0) AS n_windows, round(CASE WHEN ox IS NOT NULL THEN before END, 6) AS error_before,
  round(after, 6) AS error_after, coalesce(after < before, FALSE) AS success
FROM (
  SELECT DISTINCT subject
  FROM r) s
LEFT JOIN e2 ON e2.subject = s.subject
