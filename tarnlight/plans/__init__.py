"""Query plans and the retrieval calls built on them."""
