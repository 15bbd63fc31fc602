"""streaming of grovekit."""
