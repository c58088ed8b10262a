"""Multi-step plans: crawls and pagination chains."""
