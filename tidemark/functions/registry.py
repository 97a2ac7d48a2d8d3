"""Named factors by (group, id)."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable

from tidemark.plans.expr import Expr

_registered: dict[tuple[str, str], Callable[[], Expr]] = {}
#: Modules that register factors, by group.
MODULES = {"okx_perp": "tidemark.functions.bank"}


def register_factor(group: str, factor_id: str):
    """Decorator of a function that returns the factor's expression; a name can be taken once."""

    def keep(build: Callable[[], Expr]) -> Callable[[], Expr]:
        if (group, factor_id) in _registered:
            raise ValueError(f"factor {factor_id} of group {group} is registered already")
        _registered[group, factor_id] = build
        return build

    return keep


class FactorRegistry:
    """What has been registered, loaded on request."""

    def __init__(self) -> None:
        self._groups: set[str] = set()

    def load_group(self, group: str) -> FactorRegistry:
        if group in MODULES:
            importlib.import_module(MODULES[group])
        if not any(g == group for g, _ in _registered):
            raise KeyError(f"no factor group {group}")
        self._groups.add(group)
        return self

    def load_package(self, package: str) -> FactorRegistry:
        """Import every module of a package, with those below it, and take the groups that they register."""
        before, root = set(_registered), importlib.import_module(package)
        for m in pkgutil.walk_packages(getattr(root, "__path__", []), f"{package}."):
            importlib.import_module(m.name)
        inside = (package, f"{package}.")
        self._groups |= {g for (g, _), build in _registered.items() if (g, _) not in before or build.__module__ == inside[0] or build.__module__.startswith(inside[1])}
        return self

    def load_all(self) -> FactorRegistry:
        for group in MODULES:
            self.load_group(group)
        self._groups |= {g for g, _ in _registered}
        return self

    def _own(self) -> list[tuple[str, str]]:
        return sorted(k for k in _registered if k[0] in self._groups)

    def groups(self) -> list[str]:
        return sorted({g for g, _ in self._own()})

    def factor_ids(self) -> list[str]:
        return sorted({i for _, i in self._own()})

    def factor_ids_by_group(self, group: str) -> list[str]:
        return [i for g, i in self._own() if g == group]

    def build(self, factor_id: str, group: str | None = None) -> Expr:
        """KeyError if there is none, or if several groups have the id and none is named."""
        found = [k for k in self._own() if k[1] == factor_id and group in (None, k[0])]
        if len(found) != 1:
            raise KeyError(f"factor {factor_id}: {'ambiguous, in groups ' + ', '.join(g for g, _ in found) if found else 'unknown'}")
        return _registered[found[0]]()

    def build_all(self) -> dict[tuple[str, str], Expr]:
        return {k: _registered[k]() for k in self._own()}

    def build_group(self, group: str) -> dict[str, Expr]:
        return {i: _registered[g, i]() for g, i in self._own() if g == group}

    def __len__(self) -> int:
        return len(self._own())

    def __contains__(self, factor_id: str) -> bool:
        return any(i == factor_id for _, i in self._own())
