"""Operators for preparing training text: packing, token files, near copies, filters, language models, media columns."""
