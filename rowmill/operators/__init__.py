"""rowmill operators."""
