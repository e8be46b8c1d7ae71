"""Operators over DataFrames: ranks, decoding, sampling, numeric arrays and the language model."""
