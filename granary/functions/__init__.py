"""Part of the granary package."""
