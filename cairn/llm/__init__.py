"""Training-data operators: language ID, licence scans, near-dedup, decontamination and their kin."""
