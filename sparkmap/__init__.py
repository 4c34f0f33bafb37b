"""Response-map reconstruction and paired inference as native Spark jobs."""
