"""Streaming of the core library."""
