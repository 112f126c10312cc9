"""Operators over text for training data. Nothing outside this folder imports it."""
