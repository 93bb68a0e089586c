m AS (
  SELECT subject, epoch, max(epoch) OVER (PARTITION BY subject) AS n,
    coalesce(intensity IN ('moderate', 'vigorous', 'very_vigorous'), FALSE) AS a
  FROM d),
b1 AS (
  SELECT *, CASE WHEN epoch - lag(epoch) OVER (PARTITION BY subject ORDER BY epoch) <= 3 THEN 0 ELSE 1 END AS new
  FROM m
  WHERE a),
b2 AS (
  SELECT *, sum(new) OVER (PARTITION BY subject ORDER BY epoch) AS bout
  FROM b1),
b3 AS (
  SELECT subject, min(epoch) AS start_index, CASE WHEN max(n) - max(epoch) <= 2 THEN max(n) ELSE max(epoch) END AS end_index
  FROM b2
  GROUP BY subject, bout),
b4 AS (
  SELECT b.subject, start_index, end_index, end_index - start_index + 1 AS bout_length,
    count(*) FILTER (WHERE m.a) AS mvpa_minutes
  FROM b3 b
  JOIN m ON m.subject = b.subject AND m.epoch BETWEEN start_index AND end_index
  WHERE end_index - start_index + 1 >= 10
  GROUP BY b.subject, start_index, end_index)
