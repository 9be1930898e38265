"""Column functions: tags, text, dates, strings and statistics."""
