"""Match-telemetry analytics on PySpark: features, win probabilities and their history."""
