"""The SQL front end: text to syntax tree to DataFrame."""
