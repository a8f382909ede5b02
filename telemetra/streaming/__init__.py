"""Streaming twins of the operators that look at no later row."""
