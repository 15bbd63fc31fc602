"""sources of grovekit."""
