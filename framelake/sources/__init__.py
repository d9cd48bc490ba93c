"""Readers and writers: recordings, landmarks, regressors, timestamps, metadata, and bundles of Parquet tables."""
