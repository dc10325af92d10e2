"""Structured Streaming delivery of the completion step."""
