"""Row, window and aggregate operators over frame, granule and sample tables."""
