"""Spark operators for HTTP request analytics: ingest, labelling, leakage-safe splits,
detector training and false-positive-budget evaluation."""
