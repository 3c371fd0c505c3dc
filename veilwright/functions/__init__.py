"""Column expressions: text, spans, hashes, pseudonyms."""
