"""Training-data operators: ten large-scale corpus jobs and their queries.

Nothing outside this subpackage imports it; the entry module adds its queries
only where it is present.
"""
