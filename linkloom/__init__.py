"""Entity linkage, matching and reporting expressed as Spark DataFrame jobs."""
