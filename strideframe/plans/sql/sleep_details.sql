-- with epochs, cole_kripke, plain_states, sleep_periods
SELECT subject AS "Subject Name", '' AS "File Name", '' AS "Serial Number", 60.0::DOUBLE AS "Epoch Length",
  0.0::DOUBLE AS "Weight", 0.0::DOUBLE AS "Age", 'Undefined' AS "Gender", 'Cole-Kripke' AS "Sleep/Wake Algorithm",
  'Tudor-Locke Default' AS "Sleep Period Detection Algorithm",
  strftime(ib, '%-m/%-d/%Y %I:%M:%S %p') AS "In Bed Time", strftime(ob, '%-m/%-d/%Y %I:%M:%S %p') AS "Out Bed Time",
  round_even(se::DOUBLE, 3) AS "Efficiency", strftime(os, '%-m/%-d/%Y %I:%M:%S %p') AS "Onset",
  date_diff('minute', ib, os)::DOUBLE AS "Latency", sleep_time::DOUBLE AS "Total Sleep Time", wake_time::DOUBLE AS "WASO",
  number_of_awakenings AS "Number of Awakenings", round_even(aa::DOUBLE, 2) AS "Length of Awakenings in Minutes",
  round_even(total_counts::DOUBLE, 0) AS "Activity Counts", round_even(mi::DOUBLE, 3) AS "Movement Index",
  round_even(fi::DOUBLE, 3) AS "Fragmentation Index", round_even((mi + fi)::DOUBLE, 3) AS "Sleep Fragmentation Index"
FROM sp
