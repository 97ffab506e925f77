"""Documents, fields and stored indexes."""
