"""Functions of the core library."""
