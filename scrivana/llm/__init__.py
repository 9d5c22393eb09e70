"""Operators of a training-data pipeline over a corpus of documents; nothing else in the library imports them."""
