"""Readers and writers of run stores, traces, ratings, benchmarks and training rows."""
