"""Operators on the texts of training data. Nothing outside this folder imports it."""
