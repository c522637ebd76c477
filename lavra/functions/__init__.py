"""Column functions: regular expressions, lines of a text, scalars."""
