"""Operators for training text: personal information, packing, mixing, harmful content."""
