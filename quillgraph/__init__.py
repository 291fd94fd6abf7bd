"""Evidence retrieval and supply-graph analytics as PySpark DataFrame pipelines."""
