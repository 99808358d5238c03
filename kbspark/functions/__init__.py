"""Column functions: text, dates, URLs and ordered rule tables."""
