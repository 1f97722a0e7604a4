"""Operations of a training-data pipeline: dedup, filters, tokens, packing, scores."""
