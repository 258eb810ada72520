"""Training-data operators. Nothing else in tidemark imports this subpackage."""
