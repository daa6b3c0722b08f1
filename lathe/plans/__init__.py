"""plans of Lathe."""
