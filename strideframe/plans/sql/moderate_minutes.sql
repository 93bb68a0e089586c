-- with epochs, wear_choi, rich
SELECT subject, count(*) FILTER (WHERE wear_time AND intensity = 'moderate')::DOUBLE AS mvpa_minutes
FROM d
GROUP BY subject
