"""End-to-end pipelines that chain the operators."""
