-- with epochs, wear_choi, rich, hourly_rows
SELECT subject AS "Subject", '' AS "Filename", 60.0::DOUBLE AS "Epoch", 0.0::DOUBLE AS "Weight (lbs)", 0.0::DOUBLE AS "Age",
  '' AS "Gender", strftime(date, '%m/%d/%Y') AS "Date",
  printf('%02d:00 %s', CASE WHEN hour % 12 = 0 THEN 12 ELSE hour % 12 END, CASE WHEN hour < 12 THEN 'AM' ELSE 'PM' END) AS "Hour",
  dayname(date) AS "Day of Week", isodow(date) AS "Day of Week Num", CASE WHEN v THEN sedentary ELSE 0 END AS "Sedentary",
  CASE WHEN v THEN light ELSE 0 END AS "Light", CASE WHEN v THEN moderate ELSE 0 END AS "Moderate",
  CASE WHEN v THEN vigorous ELSE 0 END AS "Vigorous", CASE WHEN v THEN very_vigorous ELSE 0 END AS "Very Vigorous",
  printf('%.2f%%', round_even(CASE WHEN v THEN 100 * sedentary / n_epochs ELSE 0 END, 2)) AS "% in Sedentary",
  printf('%.2f%%', round_even(CASE WHEN v THEN 100 * light / n_epochs ELSE 0 END, 2)) AS "% in Light",
  printf('%.2f%%', round_even(CASE WHEN v THEN 100 * moderate / n_epochs ELSE 0 END, 2)) AS "% in Moderate",
  printf('%.2f%%', round_even(CASE WHEN v THEN 100 * vigorous / n_epochs ELSE 0 END, 2)) AS "% in Vigorous",
  printf('%.2f%%', round_even(CASE WHEN v THEN 100 * very_vigorous / n_epochs ELSE 0 END, 2)) AS "% in Very Vigorous",
  CASE WHEN v THEN total_mvpa ELSE 0 END AS "Total MVPA",
  printf('%.2f%%', round_even(CASE WHEN v THEN 100 * total_mvpa / n_epochs ELSE 0 END, 2)) AS "% in MVPA",
  CASE WHEN v THEN axis1_counts ELSE 0 END AS "Axis 1 Counts", CASE WHEN v THEN axis2_counts ELSE 0 END AS "Axis 2 Counts",
  CASE WHEN v THEN axis3_counts ELSE 0 END AS "Axis 3 Counts",
  round_even(CASE WHEN v THEN axis1_average ELSE 0 END, 1) AS "Axis 1 Average Counts",
  round_even(CASE WHEN v THEN axis2_average ELSE 0 END, 1) AS "Axis 2 Average Counts",
  round_even(CASE WHEN v THEN axis3_average ELSE 0 END, 1) AS "Axis 3 Average Counts",
  CASE WHEN v THEN axis1_max ELSE 0 END AS "Axis 1 Max Counts", CASE WHEN v THEN axis2_max ELSE 0 END AS "Axis 2 Max Counts",
  CASE WHEN v THEN axis3_max ELSE 0 END AS "Axis 3 Max Counts",
  round_even(CASE WHEN v THEN axis1_average ELSE 0 END, 1) AS "Axis 1 CPM",
  round_even(CASE WHEN v THEN axis2_average ELSE 0 END, 1) AS "Axis 2 CPM",
  round_even(CASE WHEN v THEN axis3_average ELSE 0 END, 1) AS "Axis 3 CPM",
  round_even(CASE WHEN v THEN vm_counts ELSE 0 END, 1) AS "Vector Magnitude Counts",
  round_even(CASE WHEN v THEN vm_average ELSE 0 END, 1) AS "Vector Magnitude Average Counts",
  round_even(CASE WHEN v THEN vm_max ELSE 0 END, 1) AS "Vector Magnitude Max Counts",
  round_even(CASE WHEN v THEN vm_average ELSE 0 END, 1) AS "Vector Magnitude CPM",
  CASE WHEN v THEN steps_counts ELSE 0 END AS "Steps Counts",
  round_even(CASE WHEN v THEN steps_average ELSE 0 END, 1) AS "Steps Average Counts",
  CASE WHEN v THEN steps_max ELSE 0 END AS "Steps Max Counts",
  round_even(CASE WHEN v THEN steps_average ELSE 0 END, 1) AS "Steps Per Minute", 0.0::DOUBLE AS "Lux Average Counts",
  0.0::DOUBLE AS "Lux Max Counts", CASE WHEN v THEN n_epochs ELSE 0 END AS "Number of Epochs",
  CASE WHEN v THEN n_epochs ELSE 0 END::DOUBLE AS "Time", 1::BIGINT AS "Calendar Days"
FROM rq
JOIN (
  SELECT DISTINCT subject AS s, date AS dd, is_valid_day AS v
  FROM d) ON s = subject AND dd = date
