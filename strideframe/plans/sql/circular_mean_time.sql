-- with epochs, cole_kripke, plain_states, sleep_periods
SELECT subject, round((((atan2(avg(sin((hour(ib) * 60 + minute(ib)) * 2 * pi() / 1440)),
  avg(cos((hour(ib) * 60 + minute(ib)) * 2 * pi() / 1440))) * 1440 / (2 * pi()) + 1440) % 1440))::DOUBLE, 6) AS in_bed_minutes,
  round((((atan2(avg(sin((hour(ob) * 60 + minute(ob)) * 2 * pi() / 1440)),
  avg(cos((hour(ob) * 60 + minute(ob)) * 2 * pi() / 1440))) * 1440 / (2 * pi()) + 1440) % 1440))::DOUBLE, 6) AS out_bed_minutes
FROM sp
GROUP BY subject
