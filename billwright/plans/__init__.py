"""The end-to-end jobs, each one a composition of operators."""
