"""All queries of the core and their SQL twins, by name."""

from __future__ import annotations

from chronoweave.plans import documents, layouts, problems, quality, reports, scalars, timetable

_PARTS = (problems, timetable, documents, reports, scalars, layouts, quality)
QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLE = {name: sql for part in _PARTS for name, sql in part.ORACLE.items()}
