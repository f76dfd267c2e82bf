"""Registered queries: messages are rendered from tables by SQL, parsed, and compared to the tables."""
