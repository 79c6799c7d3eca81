"""Queries over the driver's tables, one module per operator family."""
