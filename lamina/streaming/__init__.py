"""Chains over streams: a chain without a source is a projection, which Structured Streaming runs as it is."""


def transform_stream(chain, stream, *names):
    """The fields of a chain over a streaming DataFrame."""
    if not stream.isStreaming:
        raise ValueError("not a streaming DataFrame")
    return chain.apply(stream, *names)
