"""DataFrame-to-DataFrame operators. None of them collects point-sized data."""
