"""Operators for preparing training data, each one module with a general interface and one registered query."""
