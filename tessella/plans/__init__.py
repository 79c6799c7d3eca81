"""Physical-plan helpers: lineage cuts, bounded broadcasts and query registries."""
