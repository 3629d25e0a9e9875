"""Training-data operators: sharding, near-dedup, quality, decontamination, PII, HTML, BPE, secrets, language id.

Nothing else in docintake imports this subpackage.
"""
