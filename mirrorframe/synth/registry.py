"""Synthesizers by name."""

from __future__ import annotations

from mirrorframe.synth.copula import BootstrapSynthesizer, GaussianCopulaSynthesizer, SegmentSynthesizer
from mirrorframe.synth.simple import (
    ColumnSynthesizer,
    IdentitySynthesizer,
    MultiTableUniformSynthesizer,
    UniformSynthesizer,
)
from mirrorframe.synth.tables import HierarchicalSynthesizer, IndependentSynthesizer

SYNTHESIZERS = {
    cls.name: cls
    for cls in (
        IdentitySynthesizer, UniformSynthesizer, ColumnSynthesizer, GaussianCopulaSynthesizer, BootstrapSynthesizer,
        SegmentSynthesizer, MultiTableUniformSynthesizer, IndependentSynthesizer, HierarchicalSynthesizer,
    )
}


def resolve(entries: list, modality: str) -> list:
    """Instances from names, classes or instances. Wrong names, repeated names or modalities are errors."""
    found = []
    for entry in entries:
        if isinstance(entry, str):
            if entry not in SYNTHESIZERS:
                raise ValueError(f"Unknown synthesizer: {entry}")
            entry = SYNTHESIZERS[entry]
        found.append(entry() if isinstance(entry, type) else entry)
    wrong = [s.name for s in found if s.modality != modality]
    if wrong:
        raise ValueError(f"Not {modality} synthesizers: {', '.join(wrong)}")
    names = [s.name for s in found]
    repeated = sorted({n for n in names if names.count(n) > 1})
    if repeated:
        raise ValueError(f"Synthesizer names must be unique: {', '.join(repeated)}")
    return found
