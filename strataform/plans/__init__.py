"""Registered queries, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from . import content, sequential, storage, store, versions

QUERIES = {**content.QUERIES, **versions.QUERIES, **storage.QUERIES, **store.QUERIES, **sequential.QUERIES}
ORACLE = {**content.ORACLE, **versions.ORACLE, **storage.ORACLE, **store.ORACLE, **sequential.ORACLE}
