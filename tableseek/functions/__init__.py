"""Column expressions: text cleaning, cell typing, hash order and vector arithmetic."""
