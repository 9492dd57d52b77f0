"""Row-local operators on a stream of requests."""
