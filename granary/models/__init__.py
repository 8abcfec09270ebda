"""Series models, their evaluation and their selection."""
