"""Whole jobs: consolidation, rule summary and page processing."""
