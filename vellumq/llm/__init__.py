"""Operators for training-data texts. Nothing else in the library imports this subpackage."""
