"""Attestry: integrity checks over evidence ledgers and training-data operators, on Spark."""
