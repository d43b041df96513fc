"""Quernel: a Spark-first engine for multimodal-model data work."""
