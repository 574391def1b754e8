"""Operators that prepare text for training language models, each over whole tables."""
