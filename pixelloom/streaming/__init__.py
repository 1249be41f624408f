"""Streams of image files: an extension, stateless but for what the sink keeps."""
