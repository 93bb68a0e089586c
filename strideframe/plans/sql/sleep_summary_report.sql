-- with epochs, cole_kripke, plain_states, sleep_periods
g AS (
  SELECT subject, count(*) AS n,
    round(round((atan2(avg(sin((hour(ib) * 60 + minute(ib)) * 2 * pi() / 1440)),
      avg(cos((hour(ib) * 60 + minute(ib)) * 2 * pi() / 1440))) * 1440 / (2 * pi()) + 1440) % 1440, 6))::INT % 1440 AS bed,
    round(round((atan2(avg(sin((hour(ob) * 60 + minute(ob)) * 2 * pi() / 1440)),
      avg(cos((hour(ob) * 60 + minute(ob)) * 2 * pi() / 1440))) * 1440 / (2 * pi()) + 1440) % 1440, 6))::INT % 1440 AS out,
    round(round((atan2(avg(sin((hour(os) * 60 + minute(os)) * 2 * pi() / 1440)),
      avg(cos((hour(os) * 60 + minute(os)) * 2 * pi() / 1440))) * 1440 / (2 * pi()) + 1440) % 1440, 6))::INT % 1440 AS onset,
    avg(se) AS se, avg(date_diff('minute', ib, os)) AS latency, avg(sleep_time) AS st, avg(wake_time) AS wt,
    avg(number_of_awakenings) AS na, avg(aa) AS aa, avg(total_counts) AS tc, avg(mi) AS mi, avg(fi) AS fi, avg(mi + fi) AS si
  FROM sp
  GROUP BY subject)
SELECT subject AS "Subject Name", '' AS "File Name", '' AS "Serial Number", 60.0::DOUBLE AS "Epoch Length",
  0.0::DOUBLE AS "Weight", 0.0::DOUBLE AS "Age", 'Undefined' AS "Gender", 'Cole-Kripke' AS "Sleep/Wake Algorithm",
  'Tudor-Locke Default' AS "Sleep Period Detection Algorithm", n AS "Number of Sleep Periods",
  printf('%d:%02d %s', CASE WHEN bed // 60 % 12 = 0 THEN 12 ELSE bed // 60 % 12 END, bed % 60,
    CASE WHEN bed < 720 THEN 'AM' ELSE 'PM' END) AS "Average In Bed Time",
  printf('%d:%02d %s', CASE WHEN out // 60 % 12 = 0 THEN 12 ELSE out // 60 % 12 END, out % 60,
    CASE WHEN out < 720 THEN 'AM' ELSE 'PM' END) AS "Average Out Bed Time",
  round_even(se::DOUBLE, 3) AS "Average Efficiency",
  printf('%d:%02d %s', CASE WHEN onset // 60 % 12 = 0 THEN 12 ELSE onset // 60 % 12 END, onset % 60,
    CASE WHEN onset < 720 THEN 'AM' ELSE 'PM' END) AS "Average Onset",
  round_even(latency::DOUBLE, 0) AS "Average Latency", round_even(st::DOUBLE, 0) AS "Average Total Sleep Time",
  round_even(wt::DOUBLE, 2) AS "Average WASO", round_even(na::DOUBLE, 2) AS "Average Number of Awakenings",
  round_even(aa::DOUBLE, 2) AS "Average Length of Awakenings in Minutes", round_even(tc::DOUBLE, 2) AS "Average Activity Counts",
  round_even(mi::DOUBLE, 3) AS "Average Movement Index", round_even(fi::DOUBLE, 3) AS "Average Fragmentation Index",
  round_even(si::DOUBLE, 3) AS "Average Sleep Fragmentation Index"
FROM g
