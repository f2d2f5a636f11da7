"""rowmill plans."""
