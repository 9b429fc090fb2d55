"""A-4 / A-5: corpora as configuration.

A spec is data (a dict, or JSON): the corpus's name, its table, its shape, its
role, and for each argument of the shape a SQL expression over the table's
columns.  Specs are validated before anything runs: names and arguments against
the shape, expressions against the table's schema, types against what the
argument takes.  A valid spec is compiled to the shape's normaliser, so a union of
corpora stays one declarative plan.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import normalize as N

ROLES = ("train", "eval")


@dataclass(frozen=True)
class Shape:
    """A normaliser, the kinds of its column arguments and its options."""

    function: Callable[..., DataFrame]
    columns: Mapping[str, str]
    options: frozenset[str] = frozenset()
    needs: frozenset[str] = frozenset()


def _shape(function, options: Sequence[str] = (), needs: Sequence[str] = (), /, **columns: str) -> Shape:
    return Shape(function, {"sample_id": "number", **columns}, frozenset(options) | frozenset(needs), frozenset(needs))


SHAPES: dict[str, Shape] = {
    "triplets": _shape(N.build_labels, ["min_label_length"], text="text", positives="array", negatives="array"),
    "mcq_struct": _shape(N.mcq_struct, ["text_key", "label_key"], question="text", choices="struct", answer_key="text"),
    "mcq_index": _shape(N.mcq_index, question="text", choices="array", answer="number"),
    "mcq_value": _shape(N.mcq_value, question="text", choices="array", answer="text"),
    "dialogue": _shape(N.dialogue, turns="array", queries="array"),
    "map_options": _shape(N.map_options, question="text", story="text", options="map", answer="any"),
    "letter_answer": _shape(N.letter_answer, question="text", article="text", options="array", answer="text"),
    "sampled_negatives": _shape(N.sampled_negatives, ["seed", "max_negatives"], text="text", summary="text"),
    "binary_answer": _shape(N.binary_answer, question="text", answer="number"),
    "vocab_onehot": _shape(N.vocab_onehot, ["clean", "max_size"], text="text", target="text"),
    "multi_answer_map": _shape(N.multi_answer_map, question="text", explanation="text", choices="map", correct="array"),
    "all_positive": _shape(N.all_positive, text="text", labels="array"),
    "binary_names": _shape(N.binary_names, [], ["names"], text="text", label="number"),
    "class_index": _shape(N.class_index, [], ["names"], text="text", label="number"),
    "clean_class_names": _shape(N.clean_class_names, ["names", "max_size"], title="text", content="text", label="text"),
    "camel_class_names": _shape(N.camel_class_names, ["names", "max_size"], title="text", content="text", label="text"),
    "multilabel_vocab": _shape(N.multilabel_vocab, ["third_name", "max_size"], title="text", content="text", third="text", all_labels="array"),
    "dict_suffix": _shape(N.dict_suffix, [], ["mapping", "suffix"], text="text", label="any"),
}

_KINDS: dict[str, tuple[type, ...]] = {
    "text": (T.StringType,), "number": (T.IntegralType, T.BooleanType), "array": (T.ArrayType,), "map": (T.MapType,),
    "struct": (T.StructType,), "any": (T.DataType,),
}


class SpecError(ValueError):
    """All that is wrong with a spec, in one message."""


@dataclass(frozen=True)
class CorpusSpec:
    name: str
    table: str
    shape: str
    role: str
    columns: Mapping[str, str]
    options: Mapping[str, Any] = field(default_factory=dict)

    def problems(self) -> list[str]:
        """What is wrong without looking at a table."""
        if self.shape not in SHAPES:
            return [f"unknown shape {self.shape!r}"]
        shape, out = SHAPES[self.shape], []
        if self.role not in ROLES:
            out.append(f"role must be one of {ROLES}")
        out += [f"no expression for {c!r}" for c in shape.columns if c not in self.columns]
        out += [f"{self.shape} takes no {c!r}" for c in self.columns if c not in shape.columns]
        out += [f"no option {o!r}" for o in sorted(shape.needs - set(self.options))]
        out += [f"{self.shape} has no option {o!r}" for o in self.options if o not in shape.options]
        return out

    def bound(self, table: DataFrame) -> DataFrame:
        """The arguments as columns of those names; analysis only, no job."""
        out, got = self.problems(), []
        if out:
            raise SpecError(f"{self.name}: " + "; ".join(out))
        for name, kind in SHAPES[self.shape].columns.items():
            try:
                column = table.select(F.expr(self.columns[name]).alias(name)).schema[name].dataType
            except AnalysisException as e:
                out.append(f"{name}: {str(e).splitlines()[0]}")
                continue
            if not isinstance(column, _KINDS[kind]):
                out.append(f"{name}: {column.simpleString()} is no {kind}")
            got.append(F.expr(self.columns[name]).alias(name))
        if out:
            raise SpecError(f"{self.name}: " + "; ".join(out))
        return table.select(*got)

    def samples(self, table: DataFrame) -> DataFrame:
        """Canonical samples of the table."""
        shape = SHAPES[self.shape]
        return shape.function(self.bound(table), *shape.columns, **self.options)


def load_specs(data: str | Sequence[Mapping[str, Any]]) -> list[CorpusSpec]:
    """Specs from a list of dicts or its JSON; all faults are reported at once."""
    rows = json.loads(data) if isinstance(data, str) else data
    specs, faults, seen = [], [], set()
    known = {"name", "table", "shape", "role", "columns", "options"}
    for i, row in enumerate(rows):
        name = row.get("name", f"#{i}")
        missing, more = {"name", "table", "shape", "role", "columns"} - set(row), set(row) - known
        out = [f"no {k!r}" for k in sorted(missing)] + [f"unknown key {k!r}" for k in sorted(more)]
        if not out:
            spec = CorpusSpec(**row)
            out = spec.problems() + (["a second corpus of that name"] if name in seen else [])
            specs.append(spec)
        seen.add(name)
        faults += [f"{name}: {x}" for x in out]
    if faults:
        raise SpecError("; ".join(faults))
    return specs


def corpus(specs: Sequence[CorpusSpec], table: Callable[[str], DataFrame], role: str | None = None) -> DataFrame:
    """The union of all corpora (of a role): ``corpus``, ``role`` and the canonical
    sample columns.  ``table`` gives the DataFrame of a table's name; every spec is
    validated before the union is built."""
    chosen = [s for s in specs if role is None or s.role == role]
    if not chosen:
        raise SpecError(f"no corpus of role {role!r}")
    out = None
    for s in chosen:
        d = s.samples(table(s.table)).select(F.lit(s.name).alias("corpus"), F.lit(s.role).alias("role"), "sample_id", "text", "ltext", "lint")
        out = d if out is None else out.unionByName(d)
    return out
