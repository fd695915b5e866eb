"""Operators on text and vectors for training data; nothing outside this folder imports it."""
