"""Change feed, its application to a copy, and time-to-live."""
