"""Sources of the core library."""
