"""End-to-end pipelines, one per command."""
