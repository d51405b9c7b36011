"""Training-data operators: mixing, tokenising, dedup, filters, audits.

Nothing outside this folder imports it; the entry module adds its queries
only when it can be imported.
"""
