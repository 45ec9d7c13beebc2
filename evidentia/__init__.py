"""Evidence-grounded substitution analytics on PySpark."""
