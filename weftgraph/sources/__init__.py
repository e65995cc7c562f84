"""Where elements come from: mapping configuration, property schemas and table providers."""
