-- with epochs
SELECT subject, sample, round((greatest(sqrt(x*x + y*y + z*z) - 1, 0))::DOUBLE, 6) AS enmo
FROM r
