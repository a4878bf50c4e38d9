"""Job-posting and CV-match analytics as Spark DataFrame operators."""
