"""Link digests from fetched web pages and feeds, as PySpark DataFrame jobs."""
