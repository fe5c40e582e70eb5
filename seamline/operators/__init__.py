"""Operators over DataFrames: corpus, sampling, sequences, matching, evaluation, aggregates and models."""
