"""Column-level helpers. Every function returns a ``Column``; nothing runs."""
