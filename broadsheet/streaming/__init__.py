"""Incremental forms of operators on unbounded inputs."""
