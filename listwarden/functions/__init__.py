"""Column functions: names, similarity, list fields, log text."""
