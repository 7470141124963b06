"""See the package docstring of lodestar."""
