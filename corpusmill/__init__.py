"""A PySpark engine that turns text and conversation tables into model-ready training data."""
