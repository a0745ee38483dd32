"""The operators: profile, routing, checks, comparison, review and safety."""
