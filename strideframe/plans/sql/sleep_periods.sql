-- with epochs, cole_kripke, plain_states, sleep_periods
SELECT subject, start_index, last_index, strftime(ib, '%Y-%m-%d %H:%M:%S') AS in_bed_time,
  strftime(ob, '%Y-%m-%d %H:%M:%S') AS out_bed_time, strftime(os, '%Y-%m-%d %H:%M:%S') AS onset,
  sleep_time::DOUBLE AS sleep_time, wake_time::DOUBLE AS wake_time,
  number_of_awakenings, total_counts, round((aa)::DOUBLE, 6) AS average_awakening, round((mi)::DOUBLE, 6) AS movement_index,
  round((fi)::DOUBLE, 6) AS fragmentation_index, round((se)::DOUBLE, 6) AS sleep_efficiency, period_number
FROM sp
