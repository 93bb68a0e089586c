-- with epochs, wear_choi, rich, batch_rows, batch_table
SELECT *
FROM bt
