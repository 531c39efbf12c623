"""Operators of a training-data pipeline, each on its own; nothing else in the library imports them."""
