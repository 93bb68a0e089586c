c1 AS (
  SELECT subject, epoch, coalesce(axis1, 0) AS c, max(epoch) OVER (PARTITION BY subject) AS n,
    coalesce(axis1, 0) > 0 AND coalesce(axis1, 0) <= 100 AS spike
  FROM cnt),
c2 AS (
  SELECT *, epoch - row_number() OVER (PARTITION BY subject, spike ORDER BY epoch) AS g,
    CASE WHEN spike AND NOT coalesce(max(c) OVER (PARTITION BY subject ORDER BY epoch ROWS BETWEEN 1 PRECEDING
    AND 1 PRECEDING) = 0, FALSE) AND NOT coalesce(max(c) OVER (PARTITION BY subject ORDER BY epoch ROWS BETWEEN 1 FOLLOWING
    AND 1 FOLLOWING) = 0, FALSE) THEN 1 ELSE 0 END AS lonely
  FROM c1),
c3 AS (
  SELECT *, min(epoch) OVER (PARTITION BY subject, spike, g) AS run_start,
    max(epoch) OVER (PARTITION BY subject, spike, g) AS run_end
  FROM c2),
c4 AS (
  SELECT *, epoch + 60 - 1 <= n AND sum(CASE WHEN c <> 0 THEN 1
    ELSE 0 END) OVER (PARTITION BY subject ORDER BY epoch ROWS BETWEEN CURRENT ROW AND 59 FOLLOWING) <= 2
    AND max(c) OVER (PARTITION BY subject ORDER BY epoch ROWS BETWEEN CURRENT ROW AND 59 FOLLOWING) <= 100 AS qualifies,
    coalesce(min(CASE WHEN c > 100 THEN epoch END) OVER rest, n + 1) AS above,
    coalesce(min(CASE WHEN spike AND epoch = run_start AND run_end - run_start + 1 > 2 THEN epoch END) OVER rest,
    n + 1) AS long_start
  FROM c3
  WINDOW rest AS (PARTITION BY subject ORDER BY epoch ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
c5 AS (
  SELECT p.*, CASE WHEN p.spike AND p.run_end - p.epoch + 1 > 2 THEN p.epoch ELSE least(p.above, p.long_start) END AS stop_here,
    CASE WHEN p.spike AND p.run_end - p.epoch + 1 > 2 THEN p.run_end + 1 WHEN p.long_start < p.above THEN q.run_end + 1
    ELSE p.above END AS resume_here
  FROM c4 p
  LEFT JOIN c4 q ON q.subject = p.subject AND q.epoch = p.long_start),
c6 AS (
  SELECT subject, epoch, qualifies, coalesce(lead(stop_here, 60) OVER o, n + 1) - 1 AS last_epoch,
    coalesce(lead(resume_here, 60) OVER o, n + 1) AS resume,
    min(CASE WHEN qualifies THEN epoch END) OVER (PARTITION BY subject ORDER BY epoch ROWS BETWEEN CURRENT ROW
    AND UNBOUNDED FOLLOWING) AS next_start
  FROM c5
  WINDOW o AS (PARTITION BY subject ORDER BY epoch)),
chain AS (
  SELECT a.subject, b.epoch AS start, b.last_epoch, b.resume
  FROM (
    SELECT subject, min(next_start) AS s
    FROM c6
    GROUP BY subject) a
  JOIN c6 b ON b.subject = a.subject AND b.epoch = a.s
  UNION ALL
  SELECT h.subject, b.epoch, b.last_epoch, b.resume
  FROM chain h
  JOIN c6 a ON a.subject = h.subject AND a.epoch = h.resume
  JOIN c6 b ON b.subject = a.subject AND b.epoch = a.next_start),
w AS (
  SELECT cnt.*, NOT EXISTS (
    SELECT 1
    FROM chain h
    WHERE h.subject = cnt.subject AND cnt.epoch BETWEEN h.start AND h.last_epoch) AS wear_time
  FROM cnt),
p AS (
  SELECT subject, epoch, axis1, axis2, axis3, round(sqrt(axis1 * axis1 + axis2 * axis2 + axis3 * axis3), 6) AS vm, wear_time,
    CASE WHEN axis1 * 12 BETWEEN 0 AND 100 THEN 'sedentary' WHEN axis1 * 12 BETWEEN 101 AND 1951 THEN 'light'
    WHEN axis1 * 12 BETWEEN 1952 AND 5724 THEN 'moderate' WHEN axis1 * 12 BETWEEN 5725 AND 9498 THEN 'vigorous'
    WHEN axis1 * 12 >= 9499 THEN 'very_vigorous' END AS intensity
  FROM w)
