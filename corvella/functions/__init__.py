"""Column functions: text, dates, amounts, vectors."""
