"""DataFrame operators: ranks, sampling, vectors, models, selection, metrics."""
