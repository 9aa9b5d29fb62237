"""Operators for training-data pipelines: text quality, duplicates, tokens, archives and the corpus pipeline's stages."""
