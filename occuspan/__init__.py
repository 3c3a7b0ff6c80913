"""occuspan: single-molecule footprint analytics and corpus preparation as Spark plans."""
