"""Structured Streaming: predicates of the dialect over unbounded inputs."""
