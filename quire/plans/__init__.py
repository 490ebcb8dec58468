"""plans of quire."""
