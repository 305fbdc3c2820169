"""Composed queries over the panel operators."""
