"""Part of satchel; see README."""
