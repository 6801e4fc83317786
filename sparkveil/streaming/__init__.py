"""Structured Streaming forms of the operators (an extension: the task itself is batch work)."""
