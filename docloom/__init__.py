"""Document analytics on Spark: operators over OCR words, annotations and text."""
