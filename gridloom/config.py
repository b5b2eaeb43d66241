"""Options, some of them the session's own settings, and what the backend can do."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

#: Options are read from, and their values shown as, environment variables of this prefix.
PREFIX = "GRIDLOOM_"


@dataclass(frozen=True)
class Option:
    """name, default and what it is for; setting: the session's setting that holds it; startup: fixed once the manager is locked."""

    name: str
    default: object
    doc: str
    least: int = 1
    setting: str | None = None
    startup: bool = False

    def parse(self, value: object) -> object:
        if isinstance(self.default, bool):
            text = str(value).strip().lower()
            if text not in ("0", "1", "true", "false", "yes", "no", "on", "off"):
                raise ValueError(f"{self.name} is a truth value, got {value!r}")
            return text in ("1", "true", "yes", "on")
        if isinstance(self.default, int):
            if isinstance(value, bool) or isinstance(value, float) and value != int(value):
                raise ValueError(f"{self.name} is a whole number, got {value!r}")
            number = int(value)
            if number < self.least:
                raise ValueError(f"{self.name} must be {self.least} or more, got {number}")
            return number
        return type(self.default)(value)


_THREADS = "spark.sql.shuffle.partitions"
OPTIONS = (
    Option("local_cells", 2_000_000, "cells of a matrix whose solvers run on the driver", 0),
    Option("local_rows", 200_000, "rows and columns of such a matrix", 0),
    Option("factor_rows", 3_000, "rows of a matrix that is factorised on one machine", 0),
    Option("front_rows", 6_000, "rows of a front, which one task eliminates as a dense array", 1),
    Option("panel_columns", 1_024, "columns of a tall matrix (rows of a wide one) whose triangular factor one machine holds", 1),
    Option("cpu_threads", 200, "partitions of a shuffle", setting=_THREADS),
    Option("spgemm_threads", 200, "partitions of a sparse product", setting=_THREADS),
    Option("solver_threads", 200, "partitions of a solver's steps", setting=_THREADS),
)


@dataclass
class ConfigManager:
    """Named options. A value is the one that was set, else the environment's, else the default; an option that stands for a
    session's setting is read and written there. Hooks hear of each change as (name, old, new)."""

    options: dict[str, Option] = field(default_factory=lambda: {o.name: o for o in OPTIONS})
    values: dict[str, object] = field(default_factory=dict)
    hooks: dict[str | None, list[Callable]] = field(default_factory=dict)
    locked: bool = False
    #: Values of the blocks that the running thread is in; other threads don't see them.
    patched: ContextVar[dict[str, object] | None] = field(default_factory=lambda: ContextVar("patched", default=None))

    def _inside(self) -> dict[str, object]:
        return self.patched.get() or {}

    def _spark(self) -> SparkSession:
        return SparkSession.builder.getOrCreate()

    def option(self, name: str) -> Option:
        if name not in self.options:
            raise KeyError(f"unknown option {name!r}")
        return self.options[name]

    def define(self, option: Option) -> None:
        if option.name in self.options:
            raise ValueError(f"option {option.name!r} is there already")
        option.parse(option.default)
        self.options[option.name] = option

    def get(self, name: str) -> object:
        option = self.option(name)
        if option.setting:
            return int(self._spark().conf.get(option.setting))
        for own in (self._inside(), self.values):
            if name in own:
                return own[name]
        given = os.environ.get(PREFIX + name.upper())
        return option.default if given is None else option.parse(given)

    def source(self, name: str) -> str:
        """Where the value comes from: session, set, environment or default."""
        if self.option(name).setting:
            return "session"
        return "set" if name in self.values or name in self._inside() else "environment" if PREFIX + name.upper() in os.environ else "default"

    def set(self, name: str, value: object) -> None:
        option = self.option(name)
        if self.locked and option.startup:
            raise RuntimeError(f"option {name!r} is fixed since the manager was locked")
        value, old = option.parse(value), self.get(name)
        if option.setting:
            self._spark().conf.set(option.setting, str(value))
        else:
            (self._inside() if name in self._inside() else self.values)[name] = value
        self._tell(name, old)

    def reset(self, name: str) -> None:
        """Back to the environment's value or the default; a session's setting is unset."""
        option, old = self.option(name), self.get(name)
        if option.setting:
            self._spark().conf.unset(option.setting)
        self.values.pop(name, None)
        self._tell(name, old)

    def _tell(self, name: str, old: object) -> None:
        if (new := self.get(name)) != old:
            for hook in (*self.hooks.get(name, ()), *self.hooks.get(None, ())):
                hook(name, old, new)

    def on_change(self, hook: Callable, name: str | None = None) -> Callable[[], None]:
        """hook(name, old, new) is called after each change, of one option or of any; the result removes it."""
        if name is not None:
            self.option(name)
        self.hooks.setdefault(name, []).append(hook)
        return lambda: self.hooks[name].remove(hook)

    def lock(self) -> None:
        """From now on startup options can't be changed."""
        self.locked = True

    def unlock(self) -> None:
        self.locked = False

    def list(self) -> list[str]:
        return sorted(self.options)

    def describe(self, name: str) -> dict[str, object]:
        option = self.option(name)
        return {"name": name, "value": self.get(name), "default": option.default, "source": self.source(name), "doc": option.doc, "setting": option.setting, "startup": option.startup}

    def snapshot(self) -> dict[str, object]:
        return {n: self.get(n) for n in self.list()}

    def fingerprint(self) -> str:
        """The same for the same values."""
        return hashlib.sha256(json.dumps(self.snapshot(), sort_keys=True).encode()).hexdigest()

    def to_environment(self) -> dict[str, str]:
        """Puts the values into the environment, for processes that are started from here."""
        own = {PREFIX + n.upper(): str(v) for n, v in self.snapshot().items() if not self.options[n].setting}
        os.environ.update(own)
        return own

    @contextmanager
    def patch(self, **values: object) -> Iterator[ConfigManager]:
        """Options for the time of a block, in the thread that runs it; those that stand for a session's setting change for all of it."""
        before = {n: self.get(n) for n in values}
        settings = {n: self.option(n).setting for n in values}
        if self.locked and any(self.option(n).startup for n in values):
            raise RuntimeError("startup options are fixed since the manager was locked")
        parsed = {n: self.option(n).parse(v) for n, v in values.items()}
        token = self.patched.set({**self._inside(), **{n: v for n, v in parsed.items() if not settings[n]}})
        try:
            for n, v in parsed.items():
                if settings[n]:
                    self._spark().conf.set(settings[n], str(v))
                self._tell(n, before[n])
            yield self
        finally:
            now = {n: self.get(n) for n in values}
            self.patched.reset(token)
            for n in values:
                if settings[n]:
                    self._spark().conf.set(settings[n], str(before[n]))
                self._tell(n, now[n])


config = ConfigManager()


def get_config(name: str) -> object:
    return config.get(name)


def set_config(name: str, value: object) -> None:
    config.set(name, value)


def config_context(**values: object):
    return config.patch(**values)


def use_device(name: str, index: int = 0, *, require_available: bool = True) -> None:
    """Executors run on CPUs; there is nothing to choose."""
    if name != "cpu" and require_available:
        raise RuntimeError(f"no {name} device")


def use_cpu(index: int = 0, *, require_available: bool = True) -> None:
    use_device("cpu", index)


def use_gpu(index: int = 0, *, require_available: bool = True) -> None:
    use_device("gpu", index, require_available=require_available)


def is_available() -> bool:
    return True


class Capabilities:
    """What this backend has, by name: available, or not built with the reason."""

    NAMES = ("extension", "cpu", "metal", "accelerate", "cuda", "rocm")
    _AVAILABLE = {"extension": "the engine is Spark, which is there", "cpu": "executors run on CPUs"}

    def _known(self, name: str) -> str:
        name = str(name).lower().removesuffix("_kernels").removesuffix("_solvers").removeprefix("native_")
        if name not in self.NAMES:
            raise ValueError(f"unknown capability {name!r}; there are {', '.join(self.NAMES)}")
        return name

    @property
    def names(self) -> tuple[str, ...]:
        return self.NAMES

    def has(self, name: str) -> bool:
        return self._known(name) in self._AVAILABLE

    def status(self, name: str) -> str:
        return "available" if self.has(name) else "not_built"

    def reason(self, name: str) -> str:
        name = self._known(name)
        return self._AVAILABLE.get(name, f"plans run on the executors' CPUs; there is no {name} backend")

    built = runtime_available = has
    __getitem__ = __contains__ = has

    def __getattr__(self, name: str) -> bool:
        if name.lower() in self.NAMES:
            return self.has(name)
        raise AttributeError(name)

    def __repr__(self) -> str:
        return f"capabilities({', '.join(f'{n}={self.status(n)!r}' for n in self.NAMES)})"


capabilities = Capabilities()


def has_capability(capability: str) -> bool:
    return capabilities.has(capability)


class Runtime:
    """What the session runs with."""

    def resolve_n_threads(self) -> int:
        return config._spark().sparkContext.defaultParallelism

    def resolve_spgemm_threads(self) -> int:
        return int(config.get("spgemm_threads"))

    def resolve_solver_threads(self) -> int:
        return int(config.get("solver_threads"))

    context = staticmethod(config_context)

    def info(self) -> dict[str, object]:
        spark = config._spark()
        return {"spark": spark.version, "master": spark.sparkContext.master, "threads": self.resolve_n_threads(), **config.snapshot()}


runtime = Runtime()
