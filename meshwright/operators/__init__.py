"""Graph operators: views, products, frontiers, engines, primitives."""
