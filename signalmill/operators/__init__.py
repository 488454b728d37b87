"""DataFrame operators over frame, block, window and result tables."""
