"""functions of Lathe."""
