rp AS (
  SELECT subject, count(*) FILTER (WHERE (intensity = 'sedentary'))::DOUBLE AS sedentary,
    count(*) FILTER (WHERE intensity = 'light' AND TRUE)::DOUBLE AS light,
    count(*) FILTER (WHERE intensity = 'moderate' AND TRUE)::DOUBLE AS moderate,
    count(*) FILTER (WHERE intensity = 'vigorous' AND TRUE)::DOUBLE AS vigorous,
    count(*) FILTER (WHERE intensity = 'very_vigorous' AND TRUE)::DOUBLE AS very_vigorous, count(*) AS n_epochs,
    count(DISTINCT date) AS calendar_days, coalesce(sum(axis1) FILTER (WHERE TRUE), 0)::DOUBLE AS axis1_counts,
    coalesce(avg(axis1) FILTER (WHERE TRUE), 0)::DOUBLE AS axis1_average,
    coalesce(max(axis1) FILTER (WHERE TRUE), 0)::DOUBLE AS axis1_max,
    coalesce(sum(axis2) FILTER (WHERE TRUE), 0)::DOUBLE AS axis2_counts,
    coalesce(avg(axis2) FILTER (WHERE TRUE), 0)::DOUBLE AS axis2_average,
    coalesce(max(axis2) FILTER (WHERE TRUE), 0)::DOUBLE AS axis2_max,
    coalesce(sum(axis3) FILTER (WHERE TRUE), 0)::DOUBLE AS axis3_counts,
    coalesce(avg(axis3) FILTER (WHERE TRUE), 0)::DOUBLE AS axis3_average,
    coalesce(max(axis3) FILTER (WHERE TRUE), 0)::DOUBLE AS axis3_max,
    coalesce(sum(vm) FILTER (WHERE TRUE), 0)::DOUBLE AS vm_counts,
    coalesce(avg(vm) FILTER (WHERE TRUE), 0)::DOUBLE AS vm_average, coalesce(max(vm) FILTER (WHERE TRUE), 0)::DOUBLE AS vm_max,
    coalesce(sum(steps) FILTER (WHERE TRUE), 0)::DOUBLE AS steps_counts,
    coalesce(avg(steps) FILTER (WHERE TRUE), 0)::DOUBLE AS steps_average,
    coalesce(max(steps) FILTER (WHERE TRUE), 0)::DOUBLE AS steps_max
  FROM d
  WHERE TRUE
  GROUP BY ALL),
rq AS (
  SELECT *, moderate + vigorous + very_vigorous AS total_mvpa
  FROM rp),
vd AS (
  SELECT subject, count(*) FILTER (WHERE wear_epochs >= 600) AS valid_days
  FROM (
    SELECT subject, date, count(*) AS total_epochs, sum(wear_time::INT)::BIGINT AS wear_epochs
    FROM d
    GROUP BY ALL)
  GROUP BY subject)
