-- with epochs, cole_kripke
SELECT subject, epoch, sw AS sleep_wake
FROM ck
