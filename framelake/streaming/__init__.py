"""The frame-wise operators over streams: an extension, for recordings that are still being made."""
