"""Training-data operators: quality rules, language models, joins, packing and binary output."""
