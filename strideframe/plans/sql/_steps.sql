still AS (
  SELECT subject, sample AS i, y - avg(y) OVER (PARTITION BY subject) AS v, count(*) OVER (PARTITION BY subject) AS n
  FROM r),
ends AS (
  SELECT subject, n, max(v) FILTER (WHERE i = 1) AS a, max(v) FILTER (WHERE i = n) AS b
  FROM still
  GROUP BY subject, n
  HAVING n >= 28),
turned AS (
  SELECT s.subject, 29 - i AS j, 2 * a - v AS v
  FROM still s
  JOIN ends e ON e.subject = s.subject
  WHERE i BETWEEN 2 AND 28
  UNION ALL
  SELECT s.subject, i + 27, v
  FROM still s
  JOIN ends e ON e.subject = s.subject
  UNION ALL
  SELECT s.subject, e.n + 27 + e.n - i, 2 * b - v
  FROM still s
  JOIN ends e ON e.subject = s.subject
  WHERE i BETWEEN e.n - 27 AND e.n - 1),
forth_in AS (
  SELECT subject, j, 0.0017826099919254054::DOUBLE * v
    + -0.007130439967701622::DOUBLE * coalesce(lag(v, 2) OVER o, first_value(v) OVER o)
    + 0.010695659951552432::DOUBLE * coalesce(lag(v, 4) OVER o, first_value(v) OVER o)
    + -0.007130439967701622::DOUBLE * coalesce(lag(v, 6) OVER o, first_value(v) OVER o)
    + 0.0017826099919254054::DOUBLE * coalesce(lag(v, 8) OVER o, first_value(v) OVER o) AS u
  FROM turned
  WINDOW o AS (PARTITION BY subject ORDER BY j)),
forth AS (
  SELECT subject, 0::BIGINT AS j, 0::DOUBLE AS y1, 0::DOUBLE AS y2, 0::DOUBLE AS y3, 0::DOUBLE AS y4, 0::DOUBLE AS y5, 0::DOUBLE AS y6, 0::DOUBLE AS y7, 0::DOUBLE AS y8
  FROM forth_in
  WHERE j = 1
  UNION ALL
  SELECT f.subject, f.j + 1, s.u - (-6.679289586762798)::DOUBLE * f.y1 - (19.63385954395952)::DOUBLE * f.y2 - (-33.20401180518952)::DOUBLE * f.y3 - (35.35784751938564)::DOUBLE * f.y4 - (-24.28624183399106)::DOUBLE * f.y5 - (10.509374107318653)::DOUBLE * f.y6 - (-2.619468050386727)::DOUBLE * f.y7 - (0.2879304294211402)::DOUBLE * f.y8, f.y1, f.y2, f.y3, f.y4, f.y5, f.y6, f.y7
  FROM forth f
  JOIN forth_in s ON s.subject = f.subject AND s.j = f.j + 1),
back_from AS (
  SELECT f.subject, e.n + 54 + 1 - f.j AS j, f.y1 AS v
  FROM forth f
  JOIN ends e ON e.subject = f.subject
  WHERE f.j > 0),
back_in AS (
  SELECT subject, j, 0.0017826099919254054::DOUBLE * v
    + -0.007130439967701622::DOUBLE * coalesce(lag(v, 2) OVER o, first_value(v) OVER o)
    + 0.010695659951552432::DOUBLE * coalesce(lag(v, 4) OVER o, first_value(v) OVER o)
    + -0.007130439967701622::DOUBLE * coalesce(lag(v, 6) OVER o, first_value(v) OVER o)
    + 0.0017826099919254054::DOUBLE * coalesce(lag(v, 8) OVER o, first_value(v) OVER o) AS u
  FROM back_from
  WINDOW o AS (PARTITION BY subject ORDER BY j)),
back AS (
  SELECT subject, 0::BIGINT AS j, 0::DOUBLE AS y1, 0::DOUBLE AS y2, 0::DOUBLE AS y3, 0::DOUBLE AS y4, 0::DOUBLE AS y5, 0::DOUBLE AS y6, 0::DOUBLE AS y7, 0::DOUBLE AS y8
  FROM back_in
  WHERE j = 1
  UNION ALL
  SELECT f.subject, f.j + 1, s.u - (-6.679289586762798)::DOUBLE * f.y1 - (19.63385954395952)::DOUBLE * f.y2 - (-33.20401180518952)::DOUBLE * f.y3 - (35.35784751938564)::DOUBLE * f.y4 - (-24.28624183399106)::DOUBLE * f.y5 - (10.509374107318653)::DOUBLE * f.y6 - (-2.619468050386727)::DOUBLE * f.y7 - (0.2879304294211402)::DOUBLE * f.y8, f.y1, f.y2, f.y3, f.y4, f.y5, f.y6, f.y7
  FROM back f
  JOIN back_in s ON s.subject = f.subject AND s.j = f.j + 1),
band AS (
  SELECT f.subject, e.n + 54 + 1 - f.j - 27 AS i, e.n, f.y1 AS v
  FROM back f
  JOIN ends e ON e.subject = f.subject
  WHERE f.j > 0),
crossings AS (
  SELECT subject, i + 1 AS i
  FROM (
    SELECT *, lead(v) OVER (PARTITION BY subject ORDER BY i) AS next
    FROM band
    WHERE i >= 1 AND i <= n)
  WHERE v < -0.0359 AND next > 0.0359 AND i + 1 < n),
taken AS (
  SELECT subject, min(i) AS i
  FROM crossings
  GROUP BY subject
  UNION ALL
  SELECT t.subject, (
    SELECT min(c.i)
    FROM crossings c
    WHERE c.subject = t.subject AND c.i >= t.i + 9) AS i
  FROM taken t
  WHERE t.i IS NOT NULL),
st AS (
  SELECT s.subject, count(t.i) AS steps
  FROM (
    SELECT DISTINCT subject
    FROM r) s
  LEFT JOIN taken t ON t.subject = s.subject
  GROUP BY s.subject)
