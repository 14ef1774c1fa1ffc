"""What to look for (catalogue, configuration) and the registered queries."""
