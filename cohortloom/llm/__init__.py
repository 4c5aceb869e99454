"""Training-data operators: extraction, de-duplication, decontamination, filters, labels and tokens.

Nothing outside this subpackage imports it.
"""
