-- with epochs, steps
SELECT subject, steps
FROM st
