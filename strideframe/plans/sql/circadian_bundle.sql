-- with epochs, wear_choi, rich, rest_activity
sl AS (
  SELECT subject, date, hour, avg(CASE WHEN wear_time THEN axis1 END) AS x, count(CASE WHEN wear_time THEN axis1 END) AS k
  FROM d
  WHERE wear_time
  GROUP BY ALL),
sm AS (
  SELECT *, avg(x) OVER (PARTITION BY subject) AS m, x - lag(x) OVER (PARTITION BY subject ORDER BY date, hour) AS st
  FROM sl),
a AS (
  SELECT subject, count(*) AS n, sum(k) AS k, sum(pow(x - m, 2)) AS total, sum(st * st) AS steps
  FROM sm
  GROUP BY subject),
b AS (
  SELECT subject, sum(pow(xh - m, 2)) AS bt
  FROM (
    SELECT subject, hour, avg(x) AS xh, any_value(m) AS m
    FROM sm
    GROUP BY subject, hour)
  GROUP BY subject),
iv AS (
SELECT subject, round((CASE WHEN k >= 48 AND total > 0 THEN greatest(0, least(1, n * bt / (24 * total))) END)::DOUBLE,
  6) AS interdaily_stability, round((CASE WHEN k >= 48 AND total > 0 AND n > 1 THEN n * steps / ((n - 1) * total) END)::DOUBLE,
  6) AS intradaily_variability
FROM a
JOIN b USING (subject)
),
cd AS (
  SELECT subject, axis1 AS y, cos((hour(timestamp) + minute(timestamp) / 60) * 2 * pi() / 24) AS c,
    sin((hour(timestamp) + minute(timestamp) / 60) * 2 * pi() / 24) AS s
  FROM d
  WHERE wear_time),
cq AS (
  SELECT subject, count(*) AS n, avg(y) AS my, avg(c) AS mc, avg(s) AS ms, var_pop(y) AS vy, var_pop(c) AS vc, var_pop(s) AS vs,
    covar_pop(y, c) AS yc, covar_pop(y, s) AS ys, covar_pop(c, s) AS cs
  FROM cd
  GROUP BY subject),
cf AS (
  SELECT *, (yc * vs - ys * cs) / (vc * vs - cs * cs) AS be, (ys * vc - yc * cs) / (vc * vs - cs * cs) AS ga
  FROM cq
  WHERE n >= 24),
cg AS (
  SELECT *, (be * yc + ga * ys) / vy AS r2, (atan2(-ga, be) * 24 / (2 * pi()) + 24) % 24 AS ac
  FROM cf),
co AS (
SELECT subject, n, round((my - be * mc - ga * ms)::DOUBLE, 6) AS mesor, round((sqrt(be * be + ga * ga))::DOUBLE, 6) AS amplitude,
  round((ac)::DOUBLE, 6) AS acrophase, round(((24 - ac) % 24)::DOUBLE, 6) AS peak_hour, round((r2)::DOUBLE, 6) AS r_squared,
  round((pow(1 - r2, (n - 3) / 2.0))::DOUBLE, 6) AS p_value
FROM cg
),
days AS (
  SELECT subject, count(*) AS n_days, count(*) FILTER (WHERE k >= 720) AS n_valid_days
  FROM (
    SELECT subject, date, count(CASE WHEN wear_time THEN axis1 END) AS k
    FROM d
    GROUP BY ALL)
  GROUP BY subject)
SELECT subject, n_days, n_valid_days, round(l5, 6) AS l5, l5_start, round(m10, 6) AS m10, m10_start,
  round(CASE WHEN m10 + l5 <> 0 THEN (m10 - l5) / (m10 + l5) END, 6) AS ra, interdaily_stability, intradaily_variability,
  mesor, amplitude, acrophase, peak_hour, r_squared, p_value
FROM days
LEFT JOIN (
  SELECT *
  FROM l5t
  JOIN m10t USING (subject)) USING (subject)
LEFT JOIN iv USING (subject)
LEFT JOIN co USING (subject)
