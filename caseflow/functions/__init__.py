"""Column functions: dates, categories, text."""
