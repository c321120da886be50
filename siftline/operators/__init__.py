"""Rules: each is a function from records, calls or row groups to findings."""
