"""Whole runs: self-training, cross-validation, fit and predict, sweeps."""
