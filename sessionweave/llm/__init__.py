"""Training-data operations: deduplication, filtering, scanning, archiving and packing."""
