"""DataFrame operators: normalisation, metrics, quality, policy, graph, text, evaluation."""
