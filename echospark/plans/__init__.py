"""Plans: jobs built from operators, and the registered queries."""
