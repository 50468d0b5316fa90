"""Training-data operators: toxicity, language, near duplicates, personal data, quality,
main text, media columns, decontamination, byte-level BPE and secret scanning.

Nothing else in the library imports this subpackage.
"""
