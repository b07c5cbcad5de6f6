"""Plans: table store and sinks, registry, join helpers, free SQL, stand-in inputs."""
