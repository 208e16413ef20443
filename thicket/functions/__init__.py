"""Column functions: everything stays inside Catalyst expressions."""
