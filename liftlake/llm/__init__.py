"""Training-data operators: the corpus operators and their queries.

Nothing else in the library imports this subpackage; general helpers are
imported from it the other way round.
"""
