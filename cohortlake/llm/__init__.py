"""Operators for building training corpora: sharding, joins, de-duplication, classifiers, packing, archives."""
