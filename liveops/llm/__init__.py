"""Operations on training corpora; their queries are in ``queries.py``."""
