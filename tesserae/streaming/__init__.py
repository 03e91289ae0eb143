"""State that goes from micro-batch to micro-batch."""
