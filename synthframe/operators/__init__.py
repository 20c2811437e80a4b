"""Operators over DataFrames: profile, infer, clean, encode, features, split, metrics, neighbors, sample."""
