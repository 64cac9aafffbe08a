"""Operations of a training-data pipeline: tokens, packing, web archives, chat text, near-duplicates, quality.

Nothing outside this subpackage imports it; `queries.py` holds its registered queries.
"""
