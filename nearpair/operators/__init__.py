"""DataFrame operators the joins are composed of."""
