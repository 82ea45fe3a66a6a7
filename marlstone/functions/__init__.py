"""Column expressions: text, richness, routing cues, number formats."""
