"""Error profiles of sequencing technologies on Spark: mismatches, calibration, recalibration, reports."""
