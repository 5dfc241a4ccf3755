"""Lifecycle events folded into state, in batch and as a stream."""
