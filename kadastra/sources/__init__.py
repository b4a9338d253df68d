"""sources of kadastra."""
