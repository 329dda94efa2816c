"""Readers for caller files, reads, dimension tables and the driver's tables."""
