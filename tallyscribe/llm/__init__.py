"""Operators of a training-data pipeline: duplicates, tokens, quality, language-model scores, packing, toxicity."""
