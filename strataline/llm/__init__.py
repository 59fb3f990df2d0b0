"""Operators on texts for training corpora: leakage of evaluation texts, mixtures of sources, reading level."""
