-- with epochs, wear_troiano
SELECT subject, epoch, wear_time
FROM w
