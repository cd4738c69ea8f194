"""Label transfer and temporal holdout evaluation on Spark."""
