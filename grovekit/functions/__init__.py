"""functions of grovekit."""
