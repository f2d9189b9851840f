"""Column functions and numerical routines."""
