"""Training-data operators: near-dedup, licences, tokenizing, WARC, language ID,
decontamination, LM scoring, line dedup and quality rules.

Nothing outside this package imports it; ``queries.py`` registers its queries.
"""
