"""Declarations, their resolution, and the expression graphs that become plans."""
