"""Daily panel analytics (entity x trading day) as PySpark DataFrame jobs."""
