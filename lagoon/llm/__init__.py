"""Operators that prepare text corpora for training language models; nothing else imports this package."""
