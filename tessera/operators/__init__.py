"""Graph and relational operators over triples."""
