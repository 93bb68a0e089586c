-- with epochs, wear_choi
SELECT subject, epoch, wear_time
FROM w
