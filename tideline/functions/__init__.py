"""Column expressions: ratios, geography, probabilities, seasons, names, severities, ranks."""
