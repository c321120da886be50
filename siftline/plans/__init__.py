"""Plans: the registry of rules, the lint run, suppression, and the comparison of two versions of a dataset."""
