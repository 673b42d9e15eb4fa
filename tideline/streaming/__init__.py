"""Structured Streaming twins of batch operators (extensions: the batch operators have no streaming counterpart to match)."""
