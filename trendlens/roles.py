"""Column roles: which columns are categorical inputs, numeric inputs, targets."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Roles:
    categoricals: tuple[str, ...] = ()
    numerics: tuple[str, ...] = ()
    targets: tuple[str, ...] = ()
    reference_levels: dict = field(default_factory=dict)

    def __post_init__(self):
        object.__setattr__(self, "categoricals", tuple(self.categoricals))
        object.__setattr__(self, "numerics", tuple(self.numerics))
        object.__setattr__(self, "targets", tuple(self.targets))

    @property
    def inputs(self) -> list[str]:
        return list(self.categoricals) + list(self.numerics)

    @property
    def columns(self) -> list[str]:
        return self.inputs + list(self.targets)

    @property
    def parameters(self) -> list[str]:
        """Original input column names, categoricals first (roll-up order)."""
        return self.inputs
