"""Payment-fraud analytics on Spark: features, scoring, evaluation, drift and retraining."""
