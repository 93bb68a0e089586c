-- with epochs, counts, processed
SELECT subject, epoch, axis1, axis2, axis3, vm, wear_time, intensity
FROM p
