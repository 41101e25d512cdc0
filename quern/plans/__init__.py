"""The query language: tokens, syntax tree, lowering to DataFrames, session."""
