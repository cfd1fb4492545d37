"""Part of stratalex; see the README."""
