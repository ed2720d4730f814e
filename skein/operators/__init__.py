"""Operators over DataFrames; ``skein.dataset.Dataset`` is the fluent form of the same functions."""
