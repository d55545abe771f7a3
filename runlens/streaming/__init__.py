"""Structured Streaming: the same questions asked of rows as they come."""
