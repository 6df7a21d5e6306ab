"""Operators for building training data from a text corpus; nothing else imports them."""
