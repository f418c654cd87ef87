"""DataFrame operators over timelines."""
