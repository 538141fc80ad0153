"""Whole runs: from extracted features to clusters, a selection and its road tree."""
