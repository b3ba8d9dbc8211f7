"""Structured Streaming variants of ingestion and chat history."""
