"""Operators for training data: samples, mixes, encoding and subjects. Nothing else imports this subpackage."""
