"""Sources: raw catalog rows and small reference dimensions."""
