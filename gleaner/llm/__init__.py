"""Operations of a training-data pipeline: dedup, filters, extraction, tokens."""
