"""Plans of the core library."""
