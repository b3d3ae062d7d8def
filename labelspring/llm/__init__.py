"""Operations of a training-data pipeline: dedup, quality, scoring, filters, archives, mixing."""
