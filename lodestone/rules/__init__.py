"""Fixed rule values as plain constants and small lookup tables."""
