"""Operators for training-data pipelines; each module stands alone and nothing else in the library imports them."""
