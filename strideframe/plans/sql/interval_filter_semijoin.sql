-- with epochs
SELECT subject, epoch, axis1
FROM e
WHERE subject NOT IN ('s0', 's1') OR EXISTS (
  SELECT 1
  FROM e f
  WHERE f.subject = e.subject AND (f.epoch - 1) % 300 = 0
    AND e.timestamp BETWEEN f.timestamp AND f.timestamp + INTERVAL 59 MINUTES)
