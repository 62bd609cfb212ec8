"""Operators over DataFrames: similarity joins, features, scoring, clustering, repair, evaluation."""
