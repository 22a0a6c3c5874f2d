"""DataFrame operators: search, clustering, coherence, topics, merge, encoding, CV and models."""
