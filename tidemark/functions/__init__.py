"""See the package docstring of tidemark."""
