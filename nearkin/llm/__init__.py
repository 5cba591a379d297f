"""Operators that prepare documents for training language models."""
