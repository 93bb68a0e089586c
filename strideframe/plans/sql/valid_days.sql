-- with epochs, wear_choi, rich
SELECT subject, strftime(date, '%Y-%m-%d') AS date, total_epochs, wear_epochs, wear_epochs::DOUBLE AS wear_minutes,
  round((wear_epochs / 60.0)::DOUBLE, 6) AS wear_hours, wear_epochs / 60.0 >= 10 AS is_valid
FROM (
  SELECT subject, date, count(*) AS total_epochs, sum(wear_time::INT)::BIGINT AS wear_epochs
  FROM d
  GROUP BY ALL)
