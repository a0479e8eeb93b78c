"""All registered queries."""

from . import alerts, evidence, intake, register, serving, streams  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
