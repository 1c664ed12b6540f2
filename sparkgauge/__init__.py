"""Job-performance analytics over execution logs, as PySpark DataFrame jobs."""
