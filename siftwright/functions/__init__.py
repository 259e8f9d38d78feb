"""Functions that filters can call, and how to declare more."""
