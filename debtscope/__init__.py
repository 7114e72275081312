"""Code-health analytics over many source repositories, as Spark DataFrame jobs."""
