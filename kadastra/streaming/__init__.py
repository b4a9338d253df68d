"""streaming of kadastra."""
