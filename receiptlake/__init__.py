"""Receipt extraction, correction learning and quality reports as Spark jobs."""
