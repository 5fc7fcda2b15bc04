"""Modules with named, loadable parameters."""

from __future__ import annotations

import inspect
from collections.abc import Iterator
from pathlib import Path

import numpy as np

from ..sources.loader import load_config


class Module:
    """A tree of parameters (dense matrices, or None) and submodules."""

    def __init__(self) -> None:
        self._parameters: dict[str, np.ndarray | None] = {}
        self._modules: dict[str, Module] = {}

    def _check(self, name: str) -> None:
        if not name:
            raise ValueError("a name is needed")
        if "." in name:
            raise ValueError(f"{name}: names have no dots")
        if name in self._parameters or name in self._modules:
            raise ValueError(f"{name} is taken")

    def register_module(self, name: str, module: Module) -> Module:
        self._check(name)
        self._modules[name] = module
        return module

    def register_parameter(self, name: str, value: np.ndarray | None) -> np.ndarray | None:
        self._check(name)
        self._parameters[name] = value
        return value

    def named_parameters(self, recurse: bool = True) -> Iterator[tuple[str, np.ndarray]]:
        """Own parameters, then those of submodules with dotted names; None is passed over."""
        yield from ((n, p) for n, p in self._parameters.items() if p is not None)
        if recurse:
            for name, module in self._modules.items():
                yield from ((f"{name}.{n}", p) for n, p in module.named_parameters())

    def parameter(self, name: str) -> np.ndarray | None:
        return self._parameters[name]

    def load_state_dict(self, state: dict[str, np.ndarray], strict: bool = True) -> tuple[list[str], list[str]]:
        """Take in parameters by name; shapes must match.

        Gives (missing, unexpected) names; either is an error if strict.
        """
        own = dict(self.named_parameters())
        missing, unexpected = sorted(own.keys() - state.keys()), sorted(state.keys() - own.keys())
        for name in own.keys() & state.keys():
            if np.shape(state[name]) != own[name].shape:
                raise ValueError(f"{name}: shape {np.shape(state[name])} in place of {own[name].shape}")
        if strict and (missing or unexpected):
            raise KeyError(f"missing: {missing}, unexpected: {unexpected}")
        for name in own.keys() & state.keys():
            self._set(name, np.asarray(state[name], own[name].dtype))
        return missing, unexpected

    def _set(self, name: str, value: np.ndarray) -> None:
        head, _, rest = name.partition(".")
        if rest:
            self._modules[head]._set(rest, value)
        else:
            self._parameters[head] = value


def uniform(rows: int, cols: int, seed: int) -> np.ndarray:
    """Weights drawn evenly from -1/sqrt(cols) to 1/sqrt(cols)."""
    bound = 1 / np.sqrt(cols)
    return np.random.default_rng(seed).uniform(-bound, bound, (rows, cols))


def build_module(cls: type, config: dict | str | Path | tuple) -> Module:
    """A module from its constructor's arguments: a tuple, a mapping, or a JSON file."""
    if isinstance(config, tuple):
        return cls(*config)
    if isinstance(config, (str, Path)):
        config = load_config(str(config))
    wanted = inspect.signature(cls).parameters
    missing = [n for n, p in wanted.items() if p.default is p.empty and n not in config]
    if missing:
        raise KeyError(f"the configuration lacks {missing}")
    return cls(**{n: config[n] for n in wanted if n in config})
