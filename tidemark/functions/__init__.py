"""Column functions of the panel library."""
