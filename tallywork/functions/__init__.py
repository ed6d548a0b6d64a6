"""Column helpers: attributes, text, extraction, classification."""
