-- with epochs, wear_choi, rich
SELECT subject, wear_minutes, sedentary, light, moderate, vigorous, very_vigorous, mvpa,
  round((100 * sedentary / wear_minutes)::DOUBLE, 6) AS sedentary_percent,
  round((100 * light / wear_minutes)::DOUBLE, 6) AS light_percent,
  round((100 * moderate / wear_minutes)::DOUBLE, 6) AS moderate_percent,
  round((100 * vigorous / wear_minutes)::DOUBLE, 6) AS vigorous_percent,
  round((100 * very_vigorous / wear_minutes)::DOUBLE, 6) AS very_vigorous_percent,
  round((100 * mvpa / wear_minutes)::DOUBLE, 6) AS mvpa_percent
FROM (
  SELECT *, moderate + vigorous + very_vigorous AS mvpa
  FROM (
    SELECT subject, count(*)::DOUBLE AS wear_minutes, count(*) FILTER (WHERE intensity = 'sedentary')::DOUBLE AS sedentary,
      count(*) FILTER (WHERE intensity = 'light')::DOUBLE AS light,
      count(*) FILTER (WHERE intensity = 'moderate')::DOUBLE AS moderate,
      count(*) FILTER (WHERE intensity = 'vigorous')::DOUBLE AS vigorous,
      count(*) FILTER (WHERE intensity = 'very_vigorous')::DOUBLE AS very_vigorous
    FROM d
    WHERE wear_time
    GROUP BY subject))
