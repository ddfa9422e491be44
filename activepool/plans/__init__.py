"""Whole jobs: the exploration loop, retrospective scoring of runs, extraction of the best rows."""
