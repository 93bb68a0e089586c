rp AS (
  SELECT subject, date, count(*) FILTER (WHERE (intensity = 'sedentary' OR NOT wear_time))::DOUBLE AS sedentary,
    count(*) FILTER (WHERE intensity = 'light' AND wear_time)::DOUBLE AS light,
    count(*) FILTER (WHERE intensity = 'moderate' AND wear_time)::DOUBLE AS moderate,
    count(*) FILTER (WHERE intensity = 'vigorous' AND wear_time)::DOUBLE AS vigorous,
    count(*) FILTER (WHERE intensity = 'very_vigorous' AND wear_time)::DOUBLE AS very_vigorous, count(*) AS n_epochs,
    count(DISTINCT date) AS calendar_days, coalesce(sum(axis1) FILTER (WHERE wear_time), 0)::DOUBLE AS axis1_counts,
    coalesce(avg(axis1) FILTER (WHERE wear_time), 0)::DOUBLE AS axis1_average,
    coalesce(max(axis1) FILTER (WHERE wear_time), 0)::DOUBLE AS axis1_max,
    coalesce(sum(axis2) FILTER (WHERE wear_time), 0)::DOUBLE AS axis2_counts,
    coalesce(avg(axis2) FILTER (WHERE wear_time), 0)::DOUBLE AS axis2_average,
    coalesce(max(axis2) FILTER (WHERE wear_time), 0)::DOUBLE AS axis2_max,
    coalesce(sum(axis3) FILTER (WHERE wear_time), 0)::DOUBLE AS axis3_counts,
    coalesce(avg(axis3) FILTER (WHERE wear_time), 0)::DOUBLE AS axis3_average,
    coalesce(max(axis3) FILTER (WHERE wear_time), 0)::DOUBLE AS axis3_max,
    coalesce(sum(vm) FILTER (WHERE wear_time), 0)::DOUBLE AS vm_counts,
    coalesce(avg(vm) FILTER (WHERE wear_time), 0)::DOUBLE AS vm_average,
    coalesce(max(vm) FILTER (WHERE wear_time), 0)::DOUBLE AS vm_max,
    coalesce(sum(steps) FILTER (WHERE wear_time), 0)::DOUBLE AS steps_counts,
    coalesce(avg(steps) FILTER (WHERE wear_time), 0)::DOUBLE AS steps_average,
    coalesce(max(steps) FILTER (WHERE wear_time), 0)::DOUBLE AS steps_max
  FROM d
  WHERE TRUE
  GROUP BY ALL),
rq AS (
  SELECT *, moderate + vigorous + very_vigorous AS total_mvpa
  FROM rp)
