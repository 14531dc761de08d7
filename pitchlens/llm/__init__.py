"""Training-data pipeline operators: dedup, filters, scoring, mixing, tokenising, search.

Each module holds one operator with its own interface; ``queries`` registers one query per operator.
"""
