-- with epochs, wear_long_window
SELECT subject, epoch, wear_time
FROM w
