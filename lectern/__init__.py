"""Study-text analytics on PySpark."""
