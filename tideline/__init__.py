"""tideline: calendar statistics, retrieval and evaluation as plain Spark DataFrame operators."""
