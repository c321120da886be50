"""Sinks: findings and reports as JSON, SARIF, HTML, row-removal lists and text, and fixes in files."""
