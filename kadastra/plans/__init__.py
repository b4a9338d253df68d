"""plans of kadastra."""
