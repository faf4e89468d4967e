"""Operators for training-data text: encoding, mixing and language labels."""
