"""The registered queries of the sensor engine and their oracle SQL."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict = {}
