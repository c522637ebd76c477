"""Operators on texts, lines, tables, headings and page blocks."""
