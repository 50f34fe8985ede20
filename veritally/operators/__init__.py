"""DataFrame operators over requests, responses and their aggregates."""
