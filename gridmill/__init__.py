"""gridmill: utility-metering analytics written as PySpark DataFrame jobs."""
