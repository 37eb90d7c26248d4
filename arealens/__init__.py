"""Location analytics as Spark DataFrame operators."""
