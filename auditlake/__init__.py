"""Label-quality and calibration-audit jobs as Spark DataFrame operators."""
