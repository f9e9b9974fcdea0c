"""Readers: indicator tables, workbooks, HTML tables, file listings and rules."""
