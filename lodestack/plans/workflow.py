"""Workflows: named steps of verbs that yield DataFrames or values, with templates between them."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any

#: The forms of a workflow's name, of a step's alias, and of a template.
NAME = re.compile(r"[a-z][a-z0-9-]*")
ALIAS = re.compile(r"[a-z][a-z0-9_]*")
PEER = re.compile(r"mcp://[^/\s]+/[^/\s]+")
TEMPLATE = re.compile(r"\{\{\s*([A-Za-z_][\w.\[\]]*)\s*\}\}")
#: Named types of inputs, as JSON schema; `sink` marks texts that have to name a registered sink.
TYPES: dict[str, dict[str, Any]] = {
    "DocId": {"type": "string", "pattern": r"^[a-z][a-z0-9-]*://"},
    "Handle": {"type": "string", "pattern": r"^[a-z][a-z0-9-]*://"},
    "ChunkId": {"type": "string", "pattern": r"^[a-z][a-z0-9-]*://.+#chunk-[0-9a-f]{7}$"},
    "MemorySink": {"type": "string", "sink": True},
}
KINDS = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": (list, tuple), "object": Mapping, "null": type(None)}


def resolved(schema: Any) -> Any:
    """The schema with its references to named types replaced by them; what stands beside a reference wins."""
    if isinstance(schema, Mapping):
        out = {k: resolved(v) for k, v in schema.items() if k != "$ref"}
        if "$ref" in schema:
            name = re.fullmatch(r"#/types/(\w+)", str(schema["$ref"]))
            if not name or name[1] not in TYPES:
                raise ValueError(f"unknown reference {schema['$ref']}")
            out = TYPES[name[1]] | out
        return out
    return [resolved(x) for x in schema] if isinstance(schema, list | tuple) else schema


def misfits(value: Any, schema: Mapping[str, Any], name: str, sinks: Mapping[str, Any] | None = None) -> list[str]:
    """What of a value breaks its schema: type, enum, bounds, pattern, items, properties and required ones."""
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else list(kinds or [])
    fits = lambda k: isinstance(value, KINDS[k]) and not (isinstance(value, bool) and k in ("integer", "number"))
    if kinds and not any(fits(k) for k in kinds):
        return [f"{name} is no {' or '.join(kinds)}"]
    out = [f"{name} is none of {list(schema['enum'])}"] if "enum" in schema and value not in schema["enum"] else []
    number = isinstance(value, int | float) and not isinstance(value, bool)
    if number and "minimum" in schema and value < schema["minimum"]:
        out.append(f"{name} is less than {schema['minimum']}")
    if number and "maximum" in schema and value > schema["maximum"]:
        out.append(f"{name} is more than {schema['maximum']}")
    if isinstance(value, str):
        if "pattern" in schema and not re.search(schema["pattern"], value):
            out.append(f"{name} doesn't fit {schema['pattern']}")
        if len(value) < schema.get("minLength", 0):
            out.append(f"{name} is too short")
        if schema.get("sink") and sinks is not None and value not in sinks:
            out.append(f"{name} is no registered sink")
    if isinstance(value, list | tuple) and "items" in schema:
        out += [m for i, x in enumerate(value) for m in misfits(x, schema["items"], f"{name}[{i}]", sinks)]
    if isinstance(value, Mapping):
        known = schema.get("properties") or {}
        out += [f"{name}.{k} is missing" for k in schema.get("required") or () if k not in value]
        out += [m for k, v in value.items() if k in known for m in misfits(v, known[k], f"{name}.{k}", sinks)]
        out += [f"{name}.{k} isn't known" for k in value if schema.get("additionalProperties") is False and k not in known]
    return out


@dataclass(frozen=True)
class Step:
    alias: str
    verb: str
    args: Mapping[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class Workflow:
    name: str
    steps: tuple[Step, ...]
    description: str = ""
    required: tuple[str, ...] = ()
    defaults: Mapping[str, Any] = field(default_factory=dict)
    #: Aliases that the result must hold.
    output: tuple[str, ...] = ()
    #: Types of the inputs; where there are any, others are refused.
    inputs: Mapping[str, Mapping[str, Any]] = field(default_factory=dict)
    #: Handles by name that steps and the write-back may stand on.
    sources: Mapping[str, Any] = field(default_factory=dict)
    sinks: Mapping[str, Any] = field(default_factory=dict)
    shape: Mapping[str, Any] | None = None
    write_back: Mapping[str, Any] | None = None

    def problems(self, verbs: Mapping[str, Callable]) -> list[str]:
        """What is wrong with it, in order; empty if it can run."""
        out = [] if NAME.fullmatch(self.name) else [f"name {self.name!r} isn't kebab-case"]
        out += [] if self.steps else ["no steps"]
        seen: set[str] = set()
        for step in self.steps:
            out += [] if ALIAS.fullmatch(step.alias) else [f"alias {step.alias!r} isn't snake_case"]
            out += [f"alias {step.alias!r} is used twice"] if step.alias in seen else []
            out += [] if step.verb in verbs or step.verb == "literal" else [f"peer {step.verb!r} isn't registered" if PEER.fullmatch(step.verb) else f"verb {step.verb!r} isn't known"]
            seen.add(step.alias)
        out += [f"output {x!r} is no step" for x in self.output if x not in seen]
        # Templates may name inputs, handles and steps before them only.
        known = {"inputs", *self.inputs, *self.required, *self.defaults, *self.sources, *self.sinks}
        for step in self.steps:
            out += [f"step {step.alias!r} uses {x!r}, which isn't there" for x in roots(step.args) if x not in known and self.inputs]
            known.add(step.alias)
        if self.write_back is not None:
            out += [f"the write-back uses {x!r}, which isn't there" for x in roots(self.write_back) if x not in known]
        return out

    def unfit(self, inputs: Mapping[str, Any], sinks: Mapping[str, Any] | None = None) -> list[str]:
        """What is wrong with the inputs, in order."""
        out = [f"input {x!r} is missing" for x in self.required if x not in inputs]
        if self.inputs:
            out += [f"input {x!r} isn't known" for x in inputs if x not in self.inputs]
            out += [m for x, v in inputs.items() if x in self.inputs for m in misfits(v, self.inputs[x], f"input {x!r}", sinks)]
        return out

    def run(self, verbs: Mapping[str, Callable], inputs: Mapping[str, Any], write: Callable[..., Any] | None = None) -> dict[str, Any]:
        """Values of all steps by alias; DataFrames stay lazy. Steps run in order and see the inputs and the steps before them.

        All is checked before the first step runs. A declared write-back is handed to `write` (sink, kind, properties, body), whose result stands under `write_back`.
        """
        if wrong := self.problems(verbs) + self.unfit(inputs, self.sinks or None):
            raise ValueError("; ".join(wrong))
        given = {**self.defaults, **inputs}
        scope = {**{k: v.get("handle") if isinstance(v, Mapping) else v for k, v in {**self.sources, **self.sinks}.items()}, **given, "inputs": given}
        for step in self.steps:
            args = fill(step.args, scope)
            scope[step.alias] = args.get("value") if step.verb == "literal" else verbs[step.verb](**args)
        out = {s.alias: scope[s.alias] for s in self.steps}
        if self.write_back is not None and write is not None:
            told = fill(self.write_back, scope)
            out["write_back"] = write(told.get("sink"), told.get("document_kind"), told.get("properties") or {}, told.get("body_from"))
        if self.shape is not None and (wrong := misfits({"steps": {k: v for k, v in out.items() if k != "write_back"}, **({"write_back": out["write_back"]} if "write_back" in out else {})}, self.shape, "the result") if write is not None else []):
            raise ValueError("; ".join(wrong))
        return out


def roots(value: Any) -> list[str]:
    """The first names of all templates in a value, in order."""
    if isinstance(value, str):
        return [re.match(r"\w+", m)[0] for m in TEMPLATE.findall(value)]
    parts = value.values() if isinstance(value, Mapping) else value if isinstance(value, list | tuple) else ()
    return [x for v in parts for x in roots(v)]


def look_up(path: str, scope: Mapping[str, Any]) -> Any:
    """The value at a path like `a.b[0]`; KeyError where there is none."""
    value: Any = scope
    for name, number in re.findall(r"([A-Za-z_]\w*)|\[(\d+)\]", path):
        try:
            value = value[int(number)] if number else value[name]
        except (LookupError, TypeError) as error:
            raise KeyError(path) from error
    return value


def fill(value: Any, scope: Mapping[str, Any]) -> Any:
    """The value with its templates filled, at any depth. A text that is one template becomes the value itself, of any type."""
    if isinstance(value, str):
        whole = TEMPLATE.fullmatch(value.strip())
        return look_up(whole[1], scope) if whole else TEMPLATE.sub(lambda m: str(look_up(m[1], scope)), value)
    if isinstance(value, Mapping):
        return {k: fill(v, scope) for k, v in value.items()}
    return [fill(v, scope) for v in value] if isinstance(value, list | tuple) else value


def describe(workflow: Workflow) -> str:
    """Markdown about a workflow."""
    lines = [f"# {workflow.name}", "", workflow.description, "", "Inputs: " + (", ".join(workflow.required) or "none"), ""]
    return "\n".join(lines + [f"{i}. `{s.alias}` by `{s.verb}`" for i, s in enumerate(workflow.steps, 1)])


def peer(call: Callable[..., Any], seconds: float = 30.0) -> Callable[..., Any]:
    """A verb that asks another tool, and fails if it takes longer; register it by a name like mcp://server/tool."""

    def run(**args: Any) -> Any:
        pool = ThreadPoolExecutor(1)
        try:
            return pool.submit(call, **args).result(seconds)
        except TimeoutError as error:
            raise TimeoutError(f"no answer after {seconds} s") from error
        finally:
            pool.shutdown(wait=False, cancel_futures=True)

    return run


def parse(text: str) -> Workflow:
    """A workflow from YAML: version (1), name, description, inputs (name: schema, which may also say `required`), required, sources and
    sinks (name: {handle}), assembly ([as, verb, args or value]), output_shape (aliases, or a schema of the result), write_back."""
    import yaml

    told = yaml.safe_load(text)
    if not isinstance(told, Mapping) or not isinstance(told.get("assembly"), list):
        raise ValueError("a workflow is a mapping with a list `assembly`")
    if told.get("version", 1) != 1:
        raise ValueError("only version 1 is known")
    inputs = {k: resolved(v) for k, v in (told.get("inputs") or {}).items()}
    steps = tuple(Step(s["as"], s["verb"], {"value": s.get("value")} if s["verb"] == "literal" else s.get("args") or {}) for s in told["assembly"])
    needed = [k for k, v in inputs.items() if isinstance(v, Mapping) and v.get("required") is True]
    defaults = {k: v["default"] for k, v in inputs.items() if isinstance(v, Mapping) and "default" in v}
    shape = told.get("output_shape")
    schema = shape if isinstance(shape, Mapping) else None
    typed = {k: v for k, v in inputs.items() if isinstance(v, Mapping)} if len(inputs) else {}
    return Workflow(
        str(told.get("name", "")), steps, str(told.get("description", "")), tuple(dict.fromkeys([*needed, *(told.get("required") or [])])), defaults, () if schema else tuple(shape or ()),
        {k: {n: x for n, x in v.items() if n != "required" or not isinstance(x, bool)} for k, v in typed.items()}, told.get("sources") or {}, told.get("sinks") or {}, schema, told.get("write_back"),
    )


def listing(workflows: list[Workflow]) -> list[dict[str, Any]]:
    """name, steps, verbs (sorted) of each workflow, by name."""
    return [{"name": w.name, "steps": len(w.steps), "verbs": sorted({s.verb for s in w.steps})} for w in sorted(workflows, key=lambda w: w.name)]


def written_back(workflow: Workflow, values: Mapping[str, Any], alias: str, write: Callable[[Any], Any]) -> Any:
    """What `write` makes of one step's value, after a run; an alias that is no step is an error."""
    if alias not in {s.alias for s in workflow.steps}:
        raise ValueError(f"{alias!r} is no step of {workflow.name}")
    return write(values[alias])
