"""DataFrame-to-DataFrame operators. Every table carries a `series` key."""
