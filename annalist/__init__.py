"""Historical-state analytics on PySpark."""
