"""All registered queries, imported area by area."""

from __future__ import annotations

from varloom.plans import (  # noqa: F401
    checks_association,
    checks_cells,
    checks_heritability,
    checks_loci,
    checks_scalars,
    checks_traits,
    flagship,
)
from varloom.plans.registry import ORACLES, QUERIES  # noqa: F401
