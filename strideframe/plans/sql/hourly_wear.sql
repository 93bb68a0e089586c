-- with epochs, wear_choi, rich
SELECT subject, hour::BIGINT AS hour, round((100 * avg(wear_time::INT))::DOUBLE, 6) AS wear_percent
FROM d
GROUP BY ALL
