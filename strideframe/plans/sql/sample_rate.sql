-- with epochs
SELECT subject, round((1 / median(st))::DOUBLE, 6) AS sample_rate, round((median(st))::DOUBLE, 6) AS median_step
FROM (
  SELECT subject, (epoch_us(timestamp) - lag(epoch_us(timestamp)) OVER (PARTITION BY subject ORDER BY sample)) / 1e6 AS st
  FROM (
    SELECT subject, sample, timestamp
    FROM r))
GROUP BY subject
