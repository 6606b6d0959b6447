"""Colloquy: conversation-interval analytics on Spark DataFrames."""
