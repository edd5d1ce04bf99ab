"""Operators of a training-data pipeline: deduplication, extraction, tokenization,
classification and decontamination.  Nothing else in the library imports this
subpackage; it only uses PySpark, numpy and the tokenizer libraries."""
