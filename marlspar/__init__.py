"""marlspar: interaction analytics on PySpark (ingest, features, graphs, candidates, evidence)."""
