"""Operators for preparing training text; nothing else in satchel imports this."""
