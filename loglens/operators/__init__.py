"""Operators: beacon scoring, reports, indicators, suspicion index, enrichment."""
