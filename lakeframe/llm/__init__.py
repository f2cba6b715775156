"""Training-data operators: deduplication, decontamination, extraction, filtering, packing."""
