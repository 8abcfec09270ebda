"""Operators for training-data pipelines: quality, tokens, duplicates, chat formatting, decontamination and mixing."""
