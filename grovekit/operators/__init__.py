"""operators of grovekit."""
