-- with epochs
SELECT subject, round((var_samp((axis1 + axis2) / 2) / (var_samp((axis1 + axis2) / 2) + avg(pow(axis1 - axis2, 2) / 2)))::DOUBLE,
  6) AS icc
FROM e
GROUP BY subject
