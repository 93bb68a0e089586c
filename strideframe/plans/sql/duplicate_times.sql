-- with epochs
SELECT subject, strftime(timestamp, '%H:%M') AS time_of_day, count(*) AS n_rows
FROM e
GROUP BY ALL
HAVING count(*) > 1
