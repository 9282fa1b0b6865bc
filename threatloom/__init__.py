"""threatloom: threat-model analytics for many repositories, as Spark DataFrame jobs."""
