-- with epochs
SELECT subject, epoch, strftime(date, '%Y-%m-%d') AS date, axis1
FROM e
WHERE date BETWEEN DATE '2024-01-02' AND DATE '2024-01-03'
