"""sources of quire."""
