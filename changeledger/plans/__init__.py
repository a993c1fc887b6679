"""Whole commands put together from the operators."""
