"""rolloutlake: rollout, reward and training-text analytics on Spark DataFrames."""
