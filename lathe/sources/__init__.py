"""sources of Lathe."""
