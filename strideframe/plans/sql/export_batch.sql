-- with epochs, wear_choi, rich, batch_rows
SELECT subject AS "Subject", '' AS "Filename", 60.0::DOUBLE AS "Epoch", 0.0::DOUBLE AS "Weight (lbs)", 0.0::DOUBLE AS "Age",
  '' AS "Gender", sedentary AS "Sedentary", light AS "Light", moderate AS "Moderate", vigorous AS "Vigorous",
  very_vigorous AS "Very Vigorous", printf('%.2f%%', round_even(100 * sedentary / n_epochs, 2)) AS "% in Sedentary",
  printf('%.2f%%', round_even(100 * light / n_epochs, 2)) AS "% in Light",
  printf('%.2f%%', round_even(100 * moderate / n_epochs, 2)) AS "% in Moderate",
  printf('%.2f%%', round_even(100 * vigorous / n_epochs, 2)) AS "% in Vigorous",
  printf('%.2f%%', round_even(100 * very_vigorous / n_epochs, 2)) AS "% in Very Vigorous", total_mvpa AS "Total MVPA",
  printf('%.2f%%', round_even(100 * total_mvpa / n_epochs, 2)) AS "% in MVPA",
  round_even(total_mvpa / greatest(valid_days, 1), 1) AS "Average MVPA Per day", axis1_counts AS "Axis 1 Counts",
  axis2_counts AS "Axis 2 Counts", axis3_counts AS "Axis 3 Counts", round_even(axis1_average, 1) AS "Axis 1 Average Counts",
  round_even(axis2_average, 1) AS "Axis 2 Average Counts", round_even(axis3_average, 1) AS "Axis 3 Average Counts",
  axis1_max AS "Axis 1 Max Counts", axis2_max AS "Axis 2 Max Counts", axis3_max AS "Axis 3 Max Counts",
  round_even(axis1_average, 1) AS "Axis 1 CPM", round_even(axis2_average, 1) AS "Axis 2 CPM",
  round_even(axis3_average, 1) AS "Axis 3 CPM", round_even(vm_counts, 1) AS "Vector Magnitude Counts",
  round_even(vm_average, 1) AS "Vector Magnitude Average Counts", round_even(vm_max, 1) AS "Vector Magnitude Max Counts",
  round_even(vm_average, 1) AS "Vector Magnitude CPM", steps_counts AS "Steps Counts",
  round_even(steps_average, 1) AS "Steps Average Counts", steps_max AS "Steps Max Counts",
  round_even(steps_average, 1) AS "Steps Per Minute", 0.0::DOUBLE AS "Lux Average Counts", 0.0::DOUBLE AS "Lux Max Counts",
  n_epochs AS "Number of Epochs", round_even(n_epochs / 60, 1) AS "Time", valid_days AS "Calendar Days"
FROM rq
JOIN vd USING (subject)
