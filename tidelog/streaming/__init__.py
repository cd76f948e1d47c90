"""Change logs as streams: file sources, ordered state per log, append-only sinks."""
