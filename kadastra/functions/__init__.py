"""functions of kadastra."""
