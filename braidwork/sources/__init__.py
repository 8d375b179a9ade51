"""Tables and sequence inputs."""
