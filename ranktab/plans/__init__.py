"""Compositions of operators: features, learners, stacking, search, jobs."""
