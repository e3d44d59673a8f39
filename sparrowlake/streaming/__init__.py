"""Windows over event streams: an extension, as the engine's own plans are all bounded."""
