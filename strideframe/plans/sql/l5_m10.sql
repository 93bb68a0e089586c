-- with epochs, wear_choi, rich, rest_activity
SELECT subject, round((l5)::DOUBLE, 6) AS l5, l5_start, round((m10)::DOUBLE, 6) AS m10, m10_start,
  round((CASE WHEN m10 + l5 <> 0 THEN (m10 - l5) / (m10 + l5) END)::DOUBLE, 6) AS ra
FROM l5t
JOIN m10t USING (subject)
