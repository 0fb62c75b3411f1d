"""Note-event analytics on Spark: operators over performances, keyed by recording."""
