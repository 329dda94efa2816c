"""Joins, clustering, tiers, annotation, rewrite passes and aggregates over breakpoint evidence."""
