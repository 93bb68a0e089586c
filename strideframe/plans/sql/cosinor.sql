-- with epochs, wear_choi, rich
cd AS (
  SELECT subject, axis1 AS y, cos((hour(timestamp) + minute(timestamp) / 60) * 2 * pi() / 24) AS c,
    sin((hour(timestamp) + minute(timestamp) / 60) * 2 * pi() / 24) AS s
  FROM d
  WHERE wear_time),
q AS (
  SELECT subject, count(*) AS n, avg(y) AS my, avg(c) AS mc, avg(s) AS ms, var_pop(y) AS vy, var_pop(c) AS vc, var_pop(s) AS vs,
    covar_pop(y, c) AS yc, covar_pop(y, s) AS ys, covar_pop(c, s) AS cs
  FROM cd
  GROUP BY subject),
f AS (
  SELECT *, (yc * vs - ys * cs) / (vc * vs - cs * cs) AS be, (ys * vc - yc * cs) / (vc * vs - cs * cs) AS ga
  FROM q
  WHERE n >= 24),
g AS (
  SELECT *, (be * yc + ga * ys) / vy AS r2, (atan2(-ga, be) * 24 / (2 * pi()) + 24) % 24 AS ac
  FROM f)
SELECT subject, n, round((my - be * mc - ga * ms)::DOUBLE, 6) AS mesor, round((sqrt(be * be + ga * ga))::DOUBLE, 6) AS amplitude,
  round((ac)::DOUBLE, 6) AS acrophase, round(((24 - ac) % 24)::DOUBLE, 6) AS peak_hour, round((r2)::DOUBLE, 6) AS r_squared,
  round((pow(1 - r2, (n - 3) / 2.0))::DOUBLE, 6) AS p_value
FROM g
