"""Operators for building language-model corpora: percentiles, packing, mixing and subjects."""
