"""Operators for preparing training data: dedup, search, extraction,
classification, tokenising and mixing, each as a Spark job."""
