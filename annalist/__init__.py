"""Event journal, snapshot and durable-state analytics on PySpark."""
