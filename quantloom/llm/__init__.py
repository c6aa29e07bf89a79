"""Operations of a large training-data pipeline: filters, deduplication, tokenisation, formatting."""
