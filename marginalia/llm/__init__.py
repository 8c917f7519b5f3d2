"""Operators of a training-data pipeline over large corpora. Nothing else in the package imports this."""
