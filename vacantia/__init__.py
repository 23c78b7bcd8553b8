"""Job-posting and employer-filing analytics as Spark DataFrame operators."""
