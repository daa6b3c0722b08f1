"""operators of Lathe."""
