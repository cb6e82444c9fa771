"""Operators for language-model training data: name variants, match groups, matching, packing, mixing, text quality."""
