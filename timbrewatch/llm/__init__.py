"""Operators for preparing training text, written on their own; nothing else imports them."""
