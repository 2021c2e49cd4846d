"""SQL over paths, and the registered queries."""
