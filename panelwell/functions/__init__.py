"""Column expressions used by the operators: time grid, answers, probabilities, text."""
