"""File sources and sinks for articles, links, labels, vectors and metrics."""
