"""Declarative transformations: an output schema and ordered steps, with a JSON form."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from strataline.operators.dataset import Dataset
from strataline.operators.frame import Frame
from strataline.types import DataType, Schema

# Names of the steps and of their fields.
STEPS = {
    "Select": ["columns"], "Drop": ["columns"], "Rename": ["pairs"], "Cast": ["column", "to", "mode"], "FillNull": ["column", "value"],
    "WithLiteral": ["name", "value"], "DeriveMulF64": ["name", "source", "factor"], "DeriveAddF64": ["name", "source", "delta"],
}


def _value(spec: Any) -> Any:
    """A tagged value such as {"Float64": 0.0}, or "Null"."""
    if spec == "Null" or spec is None:
        return None
    if isinstance(spec, dict) and len(spec) == 1:
        (tag, value), = spec.items()
        kind = DataType.parse(tag)
        return {DataType.INT64: int, DataType.FLOAT64: float, DataType.BOOL: bool, DataType.UTF8: str}[kind](value)
    return spec


def _tagged(value: Any) -> Any:
    if value is None:
        return "Null"
    kind = "Bool" if isinstance(value, bool) else "Int64" if isinstance(value, int) else "Float64" if isinstance(value, float) else "Utf8"
    return {kind: value}


@dataclass(frozen=True)
class Step:
    kind: str
    args: dict[str, Any]

    def apply(self, frame: Frame) -> Frame:
        a = self.args
        if self.kind == "Select":
            return frame.select(a["columns"])
        if self.kind == "Drop":
            return frame.drop(a["columns"])
        if self.kind == "Rename":
            return frame.rename([tuple(p) for p in a["pairs"]])
        if self.kind == "Cast":
            return frame.cast(a["column"], a["to"], str(a.get("mode") or "strict").lower())
        if self.kind == "FillNull":
            return frame.fill_null(a["column"], _value(a["value"]))
        if self.kind == "WithLiteral":
            return frame.with_literal(a["name"], _value(a["value"]))
        if self.kind == "DeriveMulF64":
            return frame.with_mul_f64(a["name"], a["source"], a["factor"])
        return frame.with_add_f64(a["name"], a["source"], a["delta"])


@dataclass(frozen=True)
class TransformSpec:
    output: Schema
    steps: tuple[Step, ...] = ()

    @classmethod
    def build(cls, output, steps: Sequence[tuple[str, dict[str, Any]]]) -> "TransformSpec":
        for kind, args in steps:
            if kind not in STEPS or set(args) - set(STEPS[kind]):
                raise ValueError(f"unknown step {kind}({', '.join(args)})")
        return cls(Schema.of(output), tuple(Step(k, dict(a)) for k, a in steps))

    @classmethod
    def from_json(cls, text: str | dict) -> "TransformSpec":
        spec = json.loads(text) if isinstance(text, str) else text
        fields = spec["output_schema"]
        fields = fields["fields"] if isinstance(fields, dict) else fields
        return cls.build(fields, [next(iter(s.items())) for s in spec.get("steps", [])])

    def to_json(self) -> str:
        steps = [{s.kind: {k: _tagged(_value(v)) if k == "value" else v for k, v in s.args.items()}} for s in self.steps]
        fields = [{"name": f.name, "data_type": f.data_type.title} for f in self.output.fields]
        return json.dumps({"output_schema": {"fields": fields}, "steps": steps})

    def frame(self, frame: Frame) -> Frame:
        """The steps alone, lazily."""
        for s in self.steps:
            frame = s.apply(frame)
        return frame

    def apply(self, data: Dataset | Frame) -> Dataset:
        """The steps, then the columns of the output schema, cast lossily."""
        start = data.frame() if isinstance(data, Dataset) else data
        return self.frame(start).collect_with_schema(self.output)
