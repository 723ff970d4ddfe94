"""Timeline analytics and record curation on PySpark."""
