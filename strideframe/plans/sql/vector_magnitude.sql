-- with epochs
SELECT subject, epoch, round((vm)::DOUBLE, 6) AS vm
FROM e
