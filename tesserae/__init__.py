"""A PySpark engine for the data processing around an image tokenizer."""
