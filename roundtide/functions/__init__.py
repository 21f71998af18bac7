"""Column functions: pure expressions, no session and no Python workers."""
