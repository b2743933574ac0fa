"""Index schemas in JSON: analyzers, fields and mappers of source columns.

    {"analyzers": {"en": {"char_filters": [["<[^>]*>", " "]], "tokenizer": "words", "filters": ["lowercase", {"stop": ["the"]}]}},
     "fields": {"text": {"type": "text", "index_analyzer": "en", "multivalued": "false"}, "lang": {"type": "string"}},
     "field_mapper": {"ignore_case": "true", "mappings": [{"f": "body", "t": "text", "capture": {"find": "...", "replace": "$1", "fail_policy": "skip"}}]}}
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.analysis import ENGLISH_STOPS, NON_SPACE, WORDS, Analyzer
from ..operators.search import Corpus
from ..plans.parser import FieldType


class SchemaError(ValueError):
    pass


TOKENIZERS = {"words": WORDS, "whitespace": NON_SPACE, "keyword": None}
POLICIES = ("skip", "store_as_is", "exception")


def analyzer_of(spec: dict) -> Analyzer:
    """The tokenizer is a name of TOKENIZERS or {"pattern": ...}; filters apply in the order of Analyzer, whatever theirs."""
    if "tokenizer" not in spec:
        raise SchemaError("an analyzer has a tokenizer")
    tokenizer = spec["tokenizer"]
    if isinstance(tokenizer, dict):
        pattern = tokenizer["pattern"]
    elif tokenizer in TOKENIZERS:
        pattern = TOKENIZERS[tokenizer]
    else:
        raise SchemaError(f"{tokenizer} is no tokenizer")
    out = Analyzer(pattern, lowercase=False, char_filters=tuple(tuple(p) for p in spec.get("char_filters", ())), position_gap=int(spec.get("position_gap", 0)), offset_gap=int(spec.get("offset_gap", 1)))
    for f in spec.get("filters", ()):
        name, value = next(iter(f.items())) if isinstance(f, dict) else (f, None)
        match name:
            case "lowercase":
                out = replace(out, lowercase=True)
            case "fold":
                out = replace(out, fold=True)
            case "stop":
                out = replace(out, stops=out.stops | frozenset(ENGLISH_STOPS if value in (None, "english") else value))
            case "replace":
                out = replace(out, replacements=(*out.replacements, *(tuple(p) for p in value)))
            case "synonyms":
                out = replace(out, synonyms={k: tuple(v) for k, v in value.items()})
            case _:
                raise SchemaError(f"{name} is no filter")
    return out


def _spec(a: Analyzer) -> dict:
    names = {v: k for k, v in TOKENIZERS.items()}
    filters: list = ["lowercase"] * a.lowercase + ["fold"] * a.fold
    if a.replacements:
        filters.append({"replace": [list(p) for p in a.replacements]})
    if a.stops:
        filters.append({"stop": sorted(a.stops)})
    if a.synonyms:
        filters.append({"synonyms": {k: list(v) for k, v in a.synonyms.items()}})
    return {"char_filters": [list(p) for p in a.char_filters], "tokenizer": names.get(a.pattern, {"pattern": a.pattern}), "filters": filters, "position_gap": a.position_gap, "offset_gap": a.offset_gap}


@dataclass(frozen=True)
class Mapper:
    """Values of the column source go to the field target: cleaned, and with find captured from."""

    source: str
    target: str
    find: str | None = None
    into: str = "$0"
    policy: str = "skip"
    then: Mapper | None = None  # what this gives goes on to it; its own source and target don't count

    def values(self, values: Column) -> Column:
        values = cleaned(values)
        values = values if self.find is None else captured(values, self.find, self.into, self.policy)
        return values if self.then is None else self.then.values(values)


def _captures(m: Mapper | None) -> dict:
    out = []
    while m is not None:
        if m.find is not None:
            out.append({"find": m.find, "replace": m.into, "fail_policy": m.policy})
        m = m.then
    return {"capture": out if len(out) > 1 else out[0]} if out else {}


def cleaned(values: Column) -> Column:
    """Values that are not null, trimmed; white space at the begin of a line goes, and of several line ends two stay."""

    def one(v: Column) -> Column:
        v = F.regexp_replace(v, r"(?s)\A[\x00-\x20]+|[\x00-\x20]+\z", "")
        for pattern, new in ((r"\r\n[ \t]*", "\n"), (r"[\r\n][ \t]*", "\n"), (r"\n\n+", "\n\n")):
            v = F.regexp_replace(v, pattern, new)
        return v

    return F.transform(F.filter(values, lambda v: v.isNotNull()), one)


def captured(values: Column, find: str, into: str, policy: str = "skip") -> Column:
    """The template into ($n: group n) of the first match in each value; blank results go. Without a match the value goes, stays as it is, or is an error."""
    if policy not in POLICIES:
        raise SchemaError(f"{policy} is none of " + ", ".join(POLICIES))
    parts = re.split(r"\$(\d)", into)

    def one(v: Column) -> Column:
        groups = [F.lit(p) if k % 2 == 0 else F.regexp_extract(v, find, int(p)) for k, p in enumerate(parts)]
        other = {"skip": F.lit(None).cast("string"), "store_as_is": v, "exception": F.raise_error(F.concat(F.lit(f"no {find} in: "), v)).cast("string")}[policy]
        return F.when(v.rlike(find), F.concat(*groups)).otherwise(other)

    return F.filter(F.transform(values, one), lambda v: v.isNotNull() & (F.trim(v) != ""))


@dataclass(frozen=True)
class IndexSchema:
    fields: dict[str, FieldType]
    single: frozenset[str] = frozenset()  # fields of one value at most
    mappers: tuple[Mapper, ...] = ()
    ignore_case: bool = True
    analyzers: dict[str, Analyzer] = field(default_factory=dict)

    @classmethod
    def from_json(cls, text: str) -> IndexSchema:
        raw = json.loads(text)
        analyzers = {k: analyzer_of(v) for k, v in raw.get("analyzers", {}).items()}
        fields, single = {}, set()
        for name, spec in raw.get("fields", {}).items():
            kind = spec.get("type")
            if kind not in ("text", "string"):
                raise SchemaError(f"{name}: a field is of the type text or string")
            many = str(spec.get("multivalued", "true")).lower()
            if many not in ("true", "false"):
                raise SchemaError(f"{name}: multivalued is true or false")
            if many == "false":
                single.add(name)
            if kind == "string":
                fields[name] = FieldType("string", Analyzer(None, lowercase=False))
                continue
            named = [spec.get("index_analyzer"), spec.get("query_analyzer")]
            if named[0] is None or any(a is not None and a not in analyzers for a in named):
                raise SchemaError(f"{name}: no such analyzer")
            fields[name] = FieldType("text", analyzers[named[0]], analyzers.get(named[1]))
        mapping = raw.get("field_mapper", {})
        if mapping and "ignore_case" not in mapping:
            raise SchemaError("field_mapper says whether to ignore_case")
        mappers = []
        for m in mapping.get("mappings", ()):
            if m["t"] not in fields:
                raise SchemaError(f"{m['t']} is no field")
            c = m.get("capture")
            chain = None
            for one in reversed(c if isinstance(c, list) else [c]):  # a list: one after the other
                chain = Mapper(m["f"], m["t"], *((one["find"], one.get("replace", "$0"), one.get("fail_policy", "skip")) if one else ()), then=chain)
                if chain.policy not in POLICIES:
                    raise SchemaError(f"{chain.policy} is none of " + ", ".join(POLICIES))
            mappers.append(chain)
        return cls(fields, frozenset(single), tuple(mappers), str(mapping.get("ignore_case", "true")).lower() == "true", analyzers)

    def to_json(self) -> str:
        name_of = {}
        for k, a in self.analyzers.items():
            name_of.setdefault(id(a), k)
        fields = {}
        for n, f in self.fields.items():
            fields[n] = {"type": f.kind, "multivalued": str(n not in self.single).lower()}
            if f.kind == "text":
                fields[n]["index_analyzer"] = name_of[id(f.analyzer)]
                if f.normalizer is not None:
                    fields[n]["query_analyzer"] = name_of[id(f.normalizer)]
        out = {"analyzers": {k: _spec(a) for k, a in self.analyzers.items()}, "fields": fields}
        if self.mappers:
            out["field_mapper"] = {"ignore_case": str(self.ignore_case).lower(), "mappings": [{"f": m.source, "t": m.target} | _captures(m) for m in self.mappers]}
        return json.dumps(out, indent=1, ensure_ascii=False)

    def apply(self, rows: DataFrame, key: str = "doc_id") -> Corpus:
        """The rows as a corpus: mapped columns, or columns of the fields' names. A field for one value that gets more is an error when read."""
        types = dict(rows.dtypes)
        names = {c.lower() if self.ignore_case else c: c for c in rows.columns}
        columns = []
        for target in self.fields:
            mappers = [m for m in self.mappers if m.target == target] or [Mapper(target, target)]
            parts = []
            for m in mappers:
                source = names.get(m.source.lower() if self.ignore_case else m.source)
                if source is not None:
                    parts.append(m.values(F.col(source) if types[source].startswith("array") else F.array(F.col(source).cast("string"))))
            values = F.concat(*parts) if parts else F.array().cast("array<string>")
            if target in self.single:
                values = F.when(F.size(values) > 1, F.raise_error(F.lit(f"{target} has one value at most")).cast("string")).otherwise(F.get(values, 0))
            columns.append(values.alias(target))
        return Corpus(rows.select(key, *columns), key, self.fields)
