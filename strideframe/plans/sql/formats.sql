-- with epochs
SELECT subject, epoch,
  CASE WHEN epoch > 1440 THEN printf('%dd %dh %dm 0s', (epoch - 1) // 1440, (epoch - 1) % 1440 // 60, (epoch - 1) % 60)
    WHEN epoch > 60 THEN printf('%dh %dm 0s', (epoch - 1) // 60, (epoch - 1) % 60)
    WHEN epoch > 1 THEN printf('%dm 0s', epoch - 1) ELSE '0s' END AS duration,
  CASE WHEN axis1 % 250 = 0 THEN 'N/A'
    ELSE printf('%dft %din', floor(axis1 % 250 / 2.54 / 12)::INT, round_even(axis1 % 250 / 2.54 % 12, 0)::INT) END AS height,
  CASE WHEN axis1 % 200 = 0 THEN 'N/A' ELSE printf('%dlbs', round_even(axis1 % 200 * 2.20462, 0)::INT) END AS weight,
  CASE axis1 % 4 WHEN 0 THEN 'N/A' WHEN 1 THEN 'Male' WHEN 2 THEN 'Female' ELSE '3' END AS sex,
  CASE WHEN axis1 % 2 = 0 THEN 'Female' ELSE 'Undefined' END AS gender,
  strftime(timestamp, '%-m/%-d/%Y %I:%M:%S %p') AS at
FROM e
