"""Training-data operators: formatting, tokens, extraction, filters, scans, near copies, search."""
