"""Operators of a training-data pipeline over text, codes and conversations."""
