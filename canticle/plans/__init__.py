"""Helpers that shape physical plans: written intermediate tables, let-bindings, bounded lookups."""
