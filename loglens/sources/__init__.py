"""Log sources: text scan, tokeniser, per-format parsers, ingest with rejects."""
