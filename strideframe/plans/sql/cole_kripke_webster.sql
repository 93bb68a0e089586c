-- with epochs, cole_kripke, rescored_states
SELECT subject, epoch, sw AS sleep_wake
FROM states
