"""Corpus operators for training data: each in one module, their queries in `queries`."""
