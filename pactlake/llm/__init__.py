"""Training-data operators: license scans, packing, deduplication, mixing, filters, scoring."""
