"""Plans made of the operators: the registered queries, the store and the indexer."""
