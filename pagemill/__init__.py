"""pagemill: structured data from a stored or streaming corpus of web pages."""
