"""Operators of a large-scale training-data pipeline. Nothing else in docwatch imports this package."""
