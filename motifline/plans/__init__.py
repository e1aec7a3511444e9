"""Plan shapes and whole experiments built from the operators."""
