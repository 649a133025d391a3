"""Trip-analytics marts, tests and models expressed as Spark DataFrame plans."""
