"""All registered queries: importing this module imports every module of plans."""

from __future__ import annotations

from voxframe.plans import aggregation, catalogue, fusion, kernels, relational, sampling, scalars, scans, streams, windows  # noqa: F401
from voxframe.plans.registered import ORACLE_SQL, QUERIES  # noqa: F401

FLAGSHIP = "agg_corpus_er"
