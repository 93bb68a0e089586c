-- with epochs, wear_choi, rich
SELECT subject, strftime(date, '%Y-%m-%d') AS date, round((avg(mets))::DOUBLE, 6) AS average_mets
FROM d
WHERE wear_time
GROUP BY ALL
