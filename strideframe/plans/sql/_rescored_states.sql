g AS (
  SELECT *, epoch - row_number() OVER (PARTITION BY subject, sw ORDER BY epoch) AS grp
  FROM ck),
runs AS (
  SELECT subject, sw, grp, min(epoch) AS first_epoch, count(*) AS len
  FROM g
  GROUP BY ALL),
n AS (
  SELECT *, coalesce(lag(len) OVER (PARTITION BY subject ORDER BY first_epoch), 0) AS b,
    coalesce(lead(len) OVER (PARTITION BY subject ORDER BY first_epoch), 0) AS a
  FROM runs),
k AS (
  SELECT *, greatest(CASE WHEN b >= 4 THEN 1 ELSE 0 END, CASE WHEN b >= 10 AND len >= 3 THEN 3 ELSE 0 END,
    CASE WHEN b >= 15 AND len >= 4 THEN 4 ELSE 0 END,
    CASE WHEN len <= 6 AND b >= 15 AND a >= 15 OR len <= 10 AND b >= 20 AND a >= 20 THEN len ELSE 0 END) AS m
  FROM n),
states AS (
  SELECT g.* EXCLUDE (sw, grp), CASE WHEN g.sw = 'S' AND g.epoch < k.first_epoch + k.m THEN 'W' ELSE g.sw END AS sw
  FROM g
  JOIN k ON k.subject = g.subject AND k.sw = g.sw AND k.grp = g.grp)
