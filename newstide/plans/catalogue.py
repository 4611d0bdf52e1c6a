"""The registered queries and their SQL."""

from __future__ import annotations

from itertools import takewhile

from . import frames, kernels, studies
from .dialect import render, run
from .relational import SQL

QUERIES: dict = {name: run(body) for name, (_, body) in SQL.items()} | kernels.QUERIES | studies.QUERIES | frames.QUERIES
ORACLES: dict = {name: render(body, duck=True) for name, (_, body) in SQL.items()} | {name: render(body, duck=True) for name, body in kernels.ORACLE_BODIES.items()} | studies.ORACLES | frames.ORACLES
#: Survey ids by query; the README lists those that are open.
COVERS: dict = {name: ids for name, (ids, _) in SQL.items()} | {name: " ".join(takewhile(lambda x: x[:1].isupper() and x[1:].isdigit(), (f.__doc__ or "").split(":")[0].split())) for name, f in (kernels.QUERIES | studies.QUERIES | frames.QUERIES).items()}
