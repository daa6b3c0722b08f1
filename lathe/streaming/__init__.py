"""streaming of Lathe."""
