"""Operators that prepare text for training language models. Nothing outside this package imports it."""
