"""Operators for training-data pipelines over ``documents``. Nothing else in the library imports this package."""
