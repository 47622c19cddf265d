"""Readers of the engine's inputs."""
