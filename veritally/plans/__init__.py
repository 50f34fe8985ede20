"""Whole-run plans and the helpers that keep them safe at scale."""
