"""Logical tables: schemas, loaders and the two small fixed dimensions."""
