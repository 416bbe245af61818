"""footfall: telemetry alignment, effort metrics and terrain patches as Spark DataFrame operators."""
