-- with epochs, wear_choi, rich
SELECT subject, round((avg(mets))::DOUBLE, 6) AS average_mets
FROM d
WHERE wear_time
GROUP BY subject
