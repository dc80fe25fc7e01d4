"""The linkage schema: columns, comparison ladders, blocking sources; parsing, checks and the agreement-code layout."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace
from pathlib import Path

TYPES = ("string", "string_list", "date", "double", "boolean")
#: transform -> (input type, output type)
TRANSFORMS = {
    **{t: ("string", "string") for t in ("normalize", "sorted_tokens", "soundex", "email_username", "email_domain")},
    **{t: ("date", "string") for t in ("year", "month", "day", "year_month")},
}
#: level -> (types it reads, columns it reads, needs a threshold); no columns: any
LEVELS = {
    "null": (TYPES, 0, False),
    "exact": (TYPES, 1, False),
    "levenshtein": (("string",), 1, True),
    "jaro_winkler": (("string",), 1, True),
    "date_within": (("date",), 1, True),
    "numeric_within": (("double",), 1, True),
    "percentage_within": (("double",), 1, True),
    "geo_within": (("double",), 2, True),
    "list_overlap": (("string_list",), 1, True),
    "list_jaccard": (("string_list",), 1, True),
    "list_levenshtein": (("string_list",), 1, True),
    "list_jaro_winkler": (("string_list",), 1, True),
    "list_contains": ((), 2, False),
    "contains_levenshtein": ((), 2, True),
    "contains_jaro_winkler": ((), 2, True),
    "else": (TYPES, 0, False),
}
SOURCES = ("exact_value", "rare_value", "minhash", "sorted_neighbourhood", "all_pairs")
CODE_BITS = 32


class SchemaError(ValueError):
    """A schema that cannot be used; the message says why."""


def _texts(value) -> tuple[str, ...]:
    return () if value is None else (value,) if isinstance(value, str) else tuple(value)


@dataclass(frozen=True)
class Column:
    name: str
    type: str | None = None
    source: str | None = None
    transforms: tuple[str, ...] = ()
    derived_from: tuple[str, ...] = ()


@dataclass(frozen=True)
class Level:
    type: str
    threshold: float | None = None
    label: str | None = None
    column: str | None = None
    direction: str = "either"

    def describe(self) -> str:
        """The label, or the default one."""
        if self.label:
            return self.label
        t = self.threshold or 0.0
        forms = {
            "levenshtein": f"levenshtein <= {t:.0f}", "jaro_winkler": f"jaro_winkler >= {t:.2f}", "date_within": f"within {t:.0f} days" + " after" * (self.direction == "forward"),
            "numeric_within": f"within {t:.3f}", "percentage_within": f"within {100 * t:.1f}%", "geo_within": f"within {t:.2f} km", "list_overlap": f"overlap >= {t:.0f}",
            "list_jaccard": f"jaccard >= {t:.2f}", "list_contains": "value in list", "list_levenshtein": f"list_levenshtein <= {t:.0f}", "list_jaro_winkler": f"list_jaro_winkler >= {t:.2f}",
            "contains_levenshtein": f"contains_levenshtein <= {t:.0f}", "contains_jaro_winkler": f"contains_jaro_winkler >= {t:.2f}",
        }
        return forms.get(self.type, self.type)


@dataclass(frozen=True)
class Comparison:
    name: str
    columns: tuple[str, ...]
    levels: tuple[Level, ...]
    term_frequency: bool = False

    @property
    def bits(self) -> int:
        return max(1, (len(self.levels) - 1).bit_length())


@dataclass(frozen=True)
class Source:
    type: str
    column: str | None = None
    name: str = ""
    max_frequency: int = 100
    window: int = 8
    bands: int = 12
    rows_per_band: int = 4
    ngram: int = 3
    seed: int = 1
    use: str = "both"

    @property
    def em_safe(self) -> bool:
        """Whether what it selects on can be held out of an estimation."""
        return self.type != "all_pairs"


@dataclass(frozen=True)
class Schema:
    columns: tuple[Column, ...]
    comparisons: tuple[Comparison, ...] = ()
    blocking: tuple[Source, ...] = ()
    unique_id: str | None = None
    _by_name: dict = field(default_factory=dict, compare=False, repr=False)

    def column(self, name: str) -> Column:
        if not self._by_name:
            self._by_name.update({c.name: c for c in self.columns})
        if name not in self._by_name:
            raise SchemaError(f"there is no column {name!r} in the schema")
        return self._by_name[name]

    # -- layout of the agreement code

    @property
    def shifts(self) -> list[int]:
        out, at = [], 0
        for c in self.comparisons:
            out.append(at)
            at += c.bits
        return out

    @property
    def total_bits(self) -> int:
        return sum(c.bits for c in self.comparisons)

    def unpack(self, code: int) -> list[int]:
        return [code >> s & (1 << c.bits) - 1 for s, c in zip(self.shifts, self.comparisons, strict=True)]

    def pack(self, levels: list[int]) -> int:
        return sum(v << s for s, v in zip(self.shifts, levels, strict=True))

    # -- ties that the schema declares

    def origins(self, name: str) -> set[str]:
        c = self.column(name)
        return {name, *([c.source] if c.source else []), *c.derived_from}

    def same_source(self, a: str, b: str) -> bool:
        """Equal columns, one made from the other, or both from one."""
        return bool(self.origins(a) & self.origins(b))

    # -- plans for a purpose

    def for_purpose(self, purpose: str, all_pairs: bool = False) -> Schema:
        """Without the sources kept for the other purpose (estimate, predict)."""
        if all_pairs:
            return replace(self, blocking=(Source("all_pairs", name="all pairs"),), _by_name={})
        return replace(self, blocking=tuple(s for s in self.blocking if s.use in ("both", purpose)), _by_name={})

    # -- text

    @staticmethod
    def parse(text: str | dict) -> Schema:
        root = json.loads(text) if isinstance(text, str) else text
        if not isinstance(root, dict) or not root.get("columns"):
            raise SchemaError('a schema needs "columns"')
        columns = []
        for c in root["columns"]:
            if "derive" in c and "derived_from" in c:
                raise SchemaError(f"column {c['name']!r} states its origin twice: by derive and by derived_from")
            d = c.get("derive")
            columns.append(Column(c["name"], c.get("type"), d["from"] if d else None, _texts(d["transform"]) if d else (), _texts(c.get("derived_from"))))
        comparisons = []
        for c in root.get("comparisons", []):
            levels = tuple(Level(x["type"], x.get("threshold"), x.get("label"), x.get("column"), x.get("direction", "either")) for x in c.get("levels", []))
            names = _texts(c.get("columns"))
            if not names:
                raise SchemaError("a comparison needs columns")
            comparisons.append(Comparison(c.get("name") or names[0], names, levels, bool(c.get("term_frequency", False))))
        sources = []
        for s in root.get("blocking", []):
            kind = s.get("type")
            if kind not in SOURCES:
                raise SchemaError(f"{kind!r} is no way of blocking; there are {', '.join(SOURCES)}")
            if kind == "all_pairs" and "column" in s:
                raise SchemaError("all_pairs reads no column, so it names none")
            if kind != "all_pairs" and "column" not in s:
                raise SchemaError(f"{kind} blocks on a column, and none is named")
            options = {k: max(0, int(s[k])) for k in ("max_frequency", "window", "bands", "rows_per_band", "ngram", "seed") if k in s}
            name = s.get("name") or ("all pairs" if kind == "all_pairs" else f"{s['column']} {kind}")
            sources.append(Source(kind, s.get("column"), name, use=s.get("use", "both"), **options))
        schema = Schema(tuple(columns), tuple(comparisons), tuple(sources), root.get("unique_id"))
        schema.check()
        return schema

    @staticmethod
    def load(path: str) -> Schema:
        return Schema.parse(Path(path).read_text())

    def to_dict(self) -> dict:
        """Back to JSON; defaults are left out."""
        out: dict = {"unique_id": self.unique_id} if self.unique_id else {}
        out["columns"] = []
        for c in self.columns:
            x: dict = {"name": c.name}
            if c.type and not c.source:
                x["type"] = c.type
            if c.source:
                x["derive"] = {"from": c.source, "transform": c.transforms[0] if len(c.transforms) == 1 else list(c.transforms)}
            if c.derived_from:
                x["derived_from"] = list(c.derived_from)
            out["columns"].append(x)
        if self.comparisons:
            out["comparisons"] = []
            for c in self.comparisons:
                levels = []
                for v in c.levels:
                    x = {"type": v.type}
                    x |= {k: val for k, val, default in (("threshold", v.threshold, None), ("label", v.label, None), ("column", v.column, None), ("direction", v.direction, "either")) if val != default}
                    levels.append(x)
                out["comparisons"].append({"name": c.name, "columns": list(c.columns), **({"term_frequency": True} if c.term_frequency else {}), "levels": levels})
        if self.blocking:
            plain = Source("exact_value")
            out["blocking"] = []
            for s in self.blocking:
                x = {"type": s.type} | ({"column": s.column} if s.column else {}) | {"name": s.name}
                x |= {k: getattr(s, k) for k in ("max_frequency", "window", "bands", "rows_per_band", "ngram", "seed", "use") if getattr(s, k) != getattr(plain, k)}
                out["blocking"].append(x)
        return out

    def to_json(self) -> str:
        return json.dumps(self.to_dict(), indent=2)

    # -- checks

    def typed(self, types: dict[str, str]) -> Schema:
        """With the types of undeclared columns filled in, and checked again."""
        columns = []
        for c in self.columns:
            if c.source:
                columns.append(c)
            else:
                found = types.get(c.name)
                if found is None and c.type is None:
                    raise SchemaError(f"column {c.name!r} is not in the data")
                columns.append(replace(c, type=c.type or found))
        out = replace(self, columns=tuple(columns), _by_name={})
        out = replace(out, columns=tuple(replace(c, type=out.derived_type(c)) if c.source else c for c in out.columns), _by_name={})
        out.check()
        return out

    def derived_type(self, c: Column) -> str | None:
        current = self.column(c.source).type
        for t in c.transforms:
            if current is None:
                return None
            wants, gives = TRANSFORMS[t]
            if wants != current:
                raise SchemaError(f"{t} reads {wants}, but in column {c.name!r} it would meet {current}")
            current = gives
        return current

    def type_of(self, name: str) -> str | None:
        c = self.column(name)
        return self.derived_type(c) if c.source else c.type

    def check(self) -> None:
        names = [c.name for c in self.columns]
        if len(set(names)) != len(names):
            raise SchemaError("two columns have one name")
        if self.unique_id in names:
            raise SchemaError("the unique_id names records and is not compared, so it is no column")
        for c in self.columns:
            if c.type is not None and c.type not in TYPES:
                raise SchemaError(f"{c.type!r}, stated for column {c.name!r}, is no type")
            if c.source:
                if c.source == c.name:
                    raise SchemaError(f"column {c.name!r} is its own origin")
                if self.column(c.source).source:
                    raise SchemaError(f"column {c.name!r} must start from data, and {c.source!r} is made from another column; give it that one and list all transforms")
                if not c.transforms or any(t not in TRANSFORMS for t in c.transforms):
                    raise SchemaError(f"column {c.name!r} names a transform that does not exist, or none")
                self.derived_type(c)
        for c in self.comparisons:
            self._check_comparison(c)
        if self.total_bits > CODE_BITS:
            raise SchemaError(f"a code has {CODE_BITS} bits, too few for the {self.total_bits} of these comparisons")
        for s in self.blocking:
            self._check_source(s)

    def _check_comparison(self, c: Comparison) -> None:
        kinds = [v.type for v in c.levels]
        if not kinds or kinds[-1] != "else" or kinds.count("else") != 1:
            raise SchemaError(f"the last level of {c.name!r}, and no other, has to be else")
        for v in c.levels:
            if v.type not in LEVELS:
                raise SchemaError(f"{v.type!r} in {c.name!r} is no level")
            if LEVELS[v.type][2] and v.threshold is None:
                raise SchemaError(f"{v.type} in {c.name!r} lacks its threshold")
            if v.type == "percentage_within" and not 0 < v.threshold <= 1:
                raise SchemaError("the threshold of percentage_within is a share: above 0, at most 1")
            if v.direction not in ("either", "forward") or v.direction == "forward" and v.type != "date_within":
                raise SchemaError("only date_within has a direction: either, or forward")
            if v.column is not None and v.column not in c.columns:
                raise SchemaError(f"{v.type} in {c.name!r} reads {v.column!r}, which is not among the comparison's columns")
        types = [self.type_of(n) for n in c.columns]
        if None in types:
            return
        mixed = self.scalar_and_list(c)
        if not mixed and len(set(types)) > 1:
            raise SchemaError(f"the columns of {c.name!r} are of several types")
        several = len(types) > 1 and set(types) == {"string"}
        for v in c.levels:
            accepts, needs, _ = LEVELS[v.type]
            fits = mixed if v.type in ("list_contains", "contains_levenshtein", "contains_jaro_winkler") else (needs <= 1 and any(t in accepts for t in types)) if mixed else all(t in accepts for t in types)
            if not fits:
                raise SchemaError(f"{v.type} in {c.name!r} has no reading of {', '.join(types)}")
            if needs and needs != len(types) and not (needs == 1 and (mixed or several)):
                raise SchemaError(f"{v.type} in {c.name!r} takes {needs} of columns, not {len(types)}")
            if v.column is not None and not (several and needs == 1):
                raise SchemaError("a level names a column only to pick one of several strings")

    def scalar_and_list(self, c: Comparison) -> bool:
        return [self.type_of(n) for n in c.columns] == ["string", "string_list"]

    def _check_source(self, s: Source) -> None:
        if s.use not in ("both", "estimate", "predict"):
            raise SchemaError(f"{s.name!r} is for {s.use!r}; a source is for estimate, predict or both")
        if s.type == "all_pairs":
            return
        kind = self.type_of(s.column)
        if s.type == "minhash" and not (s.bands and s.rows_per_band and s.ngram):
            raise SchemaError(f"bands, rows_per_band and ngram of {s.name!r} start at one")
        if s.type == "sorted_neighbourhood" and not s.window:
            raise SchemaError(f"the window of {s.name!r} starts at one")
        if kind is None:
            return
        if kind in ("double", "string_list"):
            raise SchemaError(f"{s.name!r} cannot block on {kind}: a key is one value that can be equal")
        if s.type == "minhash" and kind != "string" or s.type == "sorted_neighbourhood" and kind == "boolean":
            raise SchemaError(f"{s.type} has no use for {kind}, so {s.name!r} cannot block on it")
