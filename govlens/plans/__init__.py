"""Plan composition: the medallion pipeline and the semantic layer."""
