"""All queries over the reference's operators with their oracle SQL."""

from __future__ import annotations

from graphloom.plans import base, clustering, detection, files, graphs, intervals, samples, text  # noqa: F401

QUERIES = base.QUERIES
ORACLE = base.ORACLE
FLAGSHIP = "w1_w2_j1_window_segments"
