"""Operators for text corpora: packing, mixing, scoring, counting, search, extraction, near-duplicate removal.

Nothing outside this folder imports it. Inputs are DataFrames; columns are named by arguments; columns an
operator does not use never reach its shuffles.
"""
