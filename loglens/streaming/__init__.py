"""Structured Streaming: the same column-expression parsers over ``readStream``."""
