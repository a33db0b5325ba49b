"""Incremental execution over growing inputs."""
