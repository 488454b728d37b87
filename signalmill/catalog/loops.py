"""SQL that takes series frame by frame: filters and followers as one recursive table, as checks of the block scans."""

from __future__ import annotations

from ..functions.filters import System


class Loop:
    """Steps of one frame, in order. An expression may use the frame's columns, earlier steps and, as ``p_<name>``, the
    value that a step with an initial value had one frame before."""

    def __init__(self):
        self.steps: list[tuple[str, str]] = []
        self.initial: dict[str, str] = {}

    def set(self, name: str, expr: str, initial: float | None = None) -> str:
        self.steps.append((name, expr))
        if initial is not None:
            self.initial[name] = f"{initial!r}::DOUBLE"
        return name

    def follow(self, name: str, target: str, falling: str, rising: str, start: float = 0.0) -> str:
        """A two-speed follower: ``falling`` while the target is below the state."""
        t = self.set(f"{name}_t", target)
        keep = self.set(f"{name}_k", f"CASE WHEN {t} < p_{name} THEN {falling} ELSE {rising} END")
        return self.set(name, f"{keep} * p_{name} + (1 - {keep}) * {t}", start)

    def section(self, name: str, x: str, coefficients: tuple) -> str:
        """A second-order section, transposed form."""
        b0, b1, b2, a1, a2 = coefficients
        y = self.set(name, f"({b0}) * ({x}) + p_{name}_u")
        self.set(f"{name}_u", f"({b1}) * ({x}) - ({a1}) * {y} + p_{name}_v", 0.0)
        self.set(f"{name}_v", f"({b2}) * ({x}) - ({a2}) * {y}", 0.0)
        return y

    def sql(self, source: str, columns: str, outputs: list[str], name: str = "st") -> str:
        """The table ``name``: ``track_id, frame_ix``, the outputs and all states."""
        kept = ", ".join(dict.fromkeys(["track_id", "frame_ix", *outputs, *self.initial]))

        def level(rows: str) -> str:
            for step, expr in self.steps:
                rows = f"SELECT *, {expr} AS {step} FROM ({rows})"
            return f"SELECT {kept} FROM ({rows})"

        first = ", ".join(f"{v} AS p_{k}" for k, v in self.initial.items())
        after = ", ".join(f"b.{k} AS p_{k}" for k in self.initial)
        mine = ", ".join(f"s.{c.strip()}" for c in columns.split(","))
        return f"""{name} AS (
{level(f"SELECT {mine}, {first} FROM {source} s WHERE frame_ix = 0")}
UNION ALL
{level(f"SELECT {mine}, {after} FROM {name} b JOIN {source} s ON s.track_id = b.track_id AND s.frame_ix = b.frame_ix + 1")})"""


def coefficients(system: System) -> tuple[str, str, str, str, str]:
    """b0, b1, b2, a1, a2 of a second-order system, as text."""
    a1, a2, b0 = -system.a[0, 0], -system.a[1, 0], system.d
    return tuple(repr(float(v)) + "::DOUBLE" for v in (b0, system.b[0] + a1 * b0, system.b[1] + a2 * b0, a1, a2))


def level_db(*values: str) -> str:
    top = f"greatest({', '.join(f'abs({v})' for v in values)})"
    return f"20 * log10(greatest({top}, 1e-12))"


def knee(level: str, threshold: str, ratio: str, width: float) -> str:
    """Static compressor curve in dB; ``ratio`` is one or more."""
    over, half = f"(({level}) - ({threshold}))", repr(width / 2)
    return (f"CASE WHEN {over} <= -{half} THEN 0 WHEN {over} >= {half} THEN (1 / ({ratio}) - 1) * {over} "
            f"ELSE (1 / ({ratio}) - 1) * pow({over} + {half}, 2) / {2 * width!r} END")


def linear(db: str) -> str:
    return f"pow(10, ({db}) / 20.0)"


def soft_clip(x: str, top: str, softness: str) -> str:
    knee_at = f"({top}) * (1 - ({softness}))"
    return (f"CASE WHEN abs({x}) >= {top} THEN sign({x}) * {top} WHEN ({softness}) > 0 AND abs({x}) > {knee_at} THEN sign({x}) * ({knee_at} + ({top}) * ({softness}) "
            f"* (1 - pow(1 - (abs({x}) - {knee_at}) / (({top}) * ({softness})), 2))) ELSE {x} END")


def limited(loop: Loop, l: str, r: str, ceiling: str, release: str, name: str = "lim") -> tuple[str, str]:
    """Both channels under a ceiling whose gain recovers slowly."""
    peak, top = loop.set(f"{name}_p", f"greatest(abs({l}), abs({r}))"), loop.set(f"{name}_c", ceiling)
    t = loop.set(f"{name}_t", f"CASE WHEN {peak} > {top} THEN {top} / {peak} ELSE 1 END")
    g = loop.set(name, f"least({t}, {release} * p_{name} + (1 - {release}) * {t})", 1.0)
    return tuple(loop.set(f"{name}_{c}", f"least(greatest({x} * {g}, -{top}), {top})") for c, x in (("l", l), ("r", r)))
