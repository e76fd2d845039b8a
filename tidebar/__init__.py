"""tidebar: time-series features, labels and walk-forward evaluation as Spark jobs."""
