d AS (
  SELECT *, axis1 AS cpm, CASE WHEN axis1 >= 0 AND axis1 <= 100 THEN 'sedentary' WHEN axis1 >= 101 AND axis1 <= 1951 THEN 'light'
    WHEN axis1 >= 1952 AND axis1 <= 5724 THEN 'moderate' WHEN axis1 >= 5725 AND axis1 <= 9498 THEN 'vigorous'
    WHEN axis1 >= 9499 THEN 'very_vigorous' END AS intensity,
    sum(wear_time::INT) OVER (PARTITION BY subject, date) / 60.0 >= 10 AS is_valid_day,
    greatest((CASE WHEN axis1 > 1951 THEN 0.00094 * axis1 + 0.1346 * 70.0 - 7.37418
    ELSE axis1 * 0.0000191 * 70.0 END) * 200 / (70.0 * 3.5), 1.0) AS mets,
    greatest((CASE WHEN axis1 > 1951 THEN 0.00094 * axis1 + 0.1346 * 70.0 - 7.37418
    ELSE axis1 * 0.0000191 * 70.0 END) * 200 / (70.0 * 3.5), 1.0) * 3.5 * 70.0 / 200 AS kcal
  FROM w)
