"""Plans: corpora, options, jobs, and the registered queries."""
