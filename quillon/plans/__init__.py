"""Plans that put operators together: configuration, pipeline, evaluation, experiments."""
