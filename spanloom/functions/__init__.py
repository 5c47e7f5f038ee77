"""Column functions: classification, names, shapes and numbers."""
