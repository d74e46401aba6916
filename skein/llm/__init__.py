"""Training-data operators: filters, joins, tokenization, packing and search.

Nothing outside this folder imports it; ``queries`` lists what it registers.
"""
