"""Views, canned queries and the polling schedule over projected tables."""
