"""Training-data operators: one module each, and `queries` with their registered forms."""
