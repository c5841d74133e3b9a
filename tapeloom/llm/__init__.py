"""Operators on text and event corpora for training data; nothing else in the library imports this."""
