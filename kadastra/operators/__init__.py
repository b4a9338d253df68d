"""operators of kadastra."""
