"""Training-data operators: language ID, quality, archives, near-duplicates, search,
toxicity, decontamination, mixing, page extraction and language-model scoring.

Nothing outside this subpackage imports it, so the rest of the library works without it.
"""
