"""Land and terrain analysis as Spark DataFrame operators."""
