"""Structured Streaming: chunks put together, copies that expire, folders that fill."""
