"""End-to-end plans that chain the operators the way a user runs them."""
