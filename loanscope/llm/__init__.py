"""Training-data operators: sharding, decontamination, language ID, joins,
dedup, mixing, secrets and quality.  Nothing else in the library imports
this subpackage; ``registry`` lists its queries and their SQL."""
