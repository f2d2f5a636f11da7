"""rowmill streaming."""
