"""Operators for building training data; nothing else in the library imports this subpackage."""
