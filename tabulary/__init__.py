"""Governed corpus analytics on Spark: a read-only query desk over registered tables.

The public surface is :class:`tabulary.desk.QueryDesk` (six calls) plus the bulk
operators in ``tabulary.operators`` and the streaming jobs in ``tabulary.streaming``.
"""

from tabulary.desk import QueryDesk
from tabulary.errors import QueryError
from tabulary.operators.filters import Clause
from tabulary.registry import DatabaseSpec, FragmentLink, Policy, Registry, TableSpec
from tabulary.session import build_session

__all__ = [
    "Clause",
    "DatabaseSpec",
    "FragmentLink",
    "Policy",
    "QueryDesk",
    "QueryError",
    "Registry",
    "TableSpec",
    "build_session",
]
