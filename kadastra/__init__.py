"""kadastra: planning-data analytics on PySpark."""
