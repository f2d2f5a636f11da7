"""rowmill functions."""
