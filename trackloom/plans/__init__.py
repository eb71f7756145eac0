"""Plan shapes shared by all operators: hot-track splitting, ordered sequences, session settings."""
