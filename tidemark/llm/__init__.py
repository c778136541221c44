"""Operations of a large-scale training-data pipeline; nothing else of the library imports them."""
