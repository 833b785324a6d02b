"""Customer voice insights as Spark DataFrame jobs."""
