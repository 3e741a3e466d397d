"""DataFrame-to-DataFrame operators over order data."""
