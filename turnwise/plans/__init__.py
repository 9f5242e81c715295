"""Plan shapes for ordered and interval work that Catalyst does not derive by itself."""
