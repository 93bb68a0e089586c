-- with epochs
SELECT subject, epoch, axis1
FROM e
WHERE timestamp BETWEEN TIMESTAMP '2024-01-01 08:00:00' AND TIMESTAMP '2024-01-01 12:00:00'
