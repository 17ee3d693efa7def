"""Resumable runs with Structured Streaming."""
