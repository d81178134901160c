"""DataFrame operators: codes, distances and searches, and their analytics."""
