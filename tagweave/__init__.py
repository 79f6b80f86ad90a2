"""Tag statistics, concept graphs and ranking metrics on PySpark."""
