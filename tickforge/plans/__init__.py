"""The SQL front-end: tokens, rewrites and the statement router."""
