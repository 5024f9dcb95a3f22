"""Column expressions: channels, decay, identities, text and vectors."""
