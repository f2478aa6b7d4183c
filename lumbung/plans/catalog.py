"""All queries over the operators, by name, with their SQL."""

from __future__ import annotations

from importlib import import_module

#: Modules of this package that hold QUERIES and ORACLES.
MODULES = ["profiles", "reports", "cleaning", "points", "serving", "answering", "requirements", "extras"]

QUERIES: dict = {}
ORACLES: dict = {}
for _name in MODULES:
    _module = import_module(f"{__package__}.{_name}")
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
