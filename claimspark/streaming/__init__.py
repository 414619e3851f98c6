"""Structured Streaming: incremental refresh of a published dataset."""
