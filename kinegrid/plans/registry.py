"""Every registered query of the trajectory library and its SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("kinematics", "movement", "inference", "reports")


def _all(name: str) -> dict:
    out: dict = {}
    for module in MODULES:
        out |= getattr(import_module(f"kinegrid.plans.{module}"), name)
    return out


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict:
    return _all("SQL")
