"""Relational operators: exact groups, similarity joins, components, pruning."""
