"""Training-data operators: text filters, joins, tokenizers, search and packing over whole tables."""
