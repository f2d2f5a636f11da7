"""rowmill sources."""
