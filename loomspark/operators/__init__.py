"""Operators of the core library."""
