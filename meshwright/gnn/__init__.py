"""Graph neural networks: modules with named parameters, and inference."""
