"""The operators over frames, pixels, series, landmarks and atlas tables."""
