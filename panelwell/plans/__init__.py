"""Compositions of operators: cohort build, window features, walk-forward evaluation."""
