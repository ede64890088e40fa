"""Every registered query; importing the modules fills the registry."""

from datasheaf.plans import (  # noqa: F401
    answers,
    experiments,
    modelscores,
    positional,
    preparation,
    roundtrips,
    streams,
    vision,
)
from datasheaf.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
