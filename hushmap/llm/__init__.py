"""Preparation of training data: quality, near-duplicates, mixing, packing, token files, chat."""
