-- with epochs, wear_choi, rich
m AS (
  SELECT subject, epoch, coalesce(intensity IN ('moderate', 'vigorous', 'very_vigorous'), FALSE)::INT AS a
  FROM d),
u AS (
  SELECT *, sum(a) OVER (PARTITION BY subject ORDER BY epoch) AS upto, max(epoch) OVER (PARTITION BY subject) AS n
  FROM m),
scan AS (
  SELECT subject, n, 1::BIGINT AS i, 0::BIGINT AS j
  FROM (
    SELECT subject, max(n) AS n
    FROM u
    GROUP BY subject)
  UNION ALL
  SELECT s.subject, s.n, CASE WHEN s.j = 0 AND x.upto - x0.before >= 8 THEN s.i WHEN s.j = 0 THEN s.i + 1
    WHEN y.upto - x0.before >= ceil(round(0.8 * (s.j + 2 - s.i), 9)) THEN s.i ELSE s.j + 1 END,
    CASE WHEN s.j = 0 AND x.upto - x0.before >= 8 THEN s.i + 9 WHEN s.j = 0 THEN 0
    WHEN y.upto - x0.before >= ceil(round(0.8 * (s.j + 2 - s.i), 9)) THEN s.j + 1 ELSE 0 END
  FROM scan s
  JOIN (
    SELECT subject, epoch, upto - a AS before
    FROM u) x0 ON x0.subject = s.subject AND x0.epoch = s.i
  LEFT JOIN u x ON x.subject = s.subject AND x.epoch = s.i + 9
  LEFT JOIN u y ON y.subject = s.subject AND y.epoch = s.j + 1
  WHERE s.j > 0 OR s.i + 9 <= s.n),
b AS (
  SELECT subject, i AS start_index, max(j) AS end_index
  FROM scan
  WHERE j > 0
  GROUP BY subject, i)
SELECT b.*, end_index - start_index + 1 AS bout_length, sum(m.a)::BIGINT AS mvpa_minutes,
  round((100.0 * sum(m.a) / (end_index - start_index + 1))::DOUBLE, 6) AS mvpa_percent,
  row_number() OVER (PARTITION BY b.subject ORDER BY start_index) AS bout_number
FROM b
JOIN m ON m.subject = b.subject AND m.epoch BETWEEN start_index AND end_index
GROUP BY b.subject, start_index, end_index
