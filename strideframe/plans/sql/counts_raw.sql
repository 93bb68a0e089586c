-- with epochs, counts
SELECT subject, epoch, axis1, axis2, axis3
FROM cnt
