"""Training-data operators: scoring, packing, dedup, sharding, PII, decontamination, toxicity, quality."""
