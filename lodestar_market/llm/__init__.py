"""Operators for large text corpora, beside the market jobs; nothing else imports them."""
