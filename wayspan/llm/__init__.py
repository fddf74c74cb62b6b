"""Operators on items and texts for training data; nothing outside this folder imports them."""
