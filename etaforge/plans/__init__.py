"""End-to-end jobs: features, training, scoring, evaluation."""
