"""Operators for training data: source files, credentials, leaks, mixes and shared spans. Nothing else imports this."""
