"""DataFrame operators of the preprocessing job."""
