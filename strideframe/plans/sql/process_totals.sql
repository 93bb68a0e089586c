-- with epochs, counts, processed, steps
SELECT s.subject, round(coalesce(sum(p.axis1) FILTER (WHERE p.wear_time), 0)::DOUBLE, 6) AS total_counts_y,
  round(coalesce(sum(sqrt(p.axis1 * p.axis1 + p.axis2 * p.axis2 + p.axis3 * p.axis3)) FILTER (WHERE p.wear_time), 0)::DOUBLE, 6) AS total_counts_vm,
  round((count(*) FILTER (WHERE p.wear_time) * 5 / 60)::DOUBLE, 6) AS total_wear_minutes,
  round((count(*) FILTER (WHERE p.wear_time AND p.intensity IN ('moderate', 'vigorous', 'very_vigorous')) * 5 / 60)::DOUBLE, 6) AS mvpa_minutes,
  any_value(s.steps) AS total_steps
FROM st s
LEFT JOIN p ON p.subject = s.subject
GROUP BY s.subject
