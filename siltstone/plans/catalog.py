"""All registered queries of the library."""

from __future__ import annotations

from siltstone.plans import ORACLES, QUERIES, code, pipeline, relational, review, textual  # noqa: F401  registers them

FLAGSHIP = QUERIES["f5_findings_filtered"]
