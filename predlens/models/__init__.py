"""Classifiers MLlib does not have, as pipeline stages, and the suite that compares all."""
