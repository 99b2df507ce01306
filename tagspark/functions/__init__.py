"""Column expressions: text, paths, answers, images and tag arrays."""
