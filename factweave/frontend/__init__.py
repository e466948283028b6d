"""From source text to fact rows. Syntax stays in the Python worker; only rows leave it."""
