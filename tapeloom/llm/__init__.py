"""Training-data operators: mixing, fingerprints, extraction, scanning, models, media and packing."""
