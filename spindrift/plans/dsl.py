"""The predicate language over traces, compiled to one Column.

    success == false and (steps > 12 or tools contains 'get_item') and created >= 2w ago

Comparisons have two values only: none is equal to none, and a comparison of unlike types is false, never an error. A set
equals no word (`contains` and `in` ask for membership). Keywords are read in any case. Texts are cut to 4096 characters
before a pattern is tried; patterns have at most 256, expressions 4000, parentheses at most 50 levels.
"""

from __future__ import annotations

import re
import time
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALARS = {"id": "trace_id", "task": "task", "success": "success", "model": "model", "created": "created", "steps": "steps", "tokens": "tokens", "duration": "duration", "max_latency": "max_latency", "errors": "errors"}
TEXTS, SETS, LISTS = {"id", "task", "model"}, {"mode", "agents", "tools"}, {"failed_tools", "failed_agents"}
UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}
TOKEN = re.compile(r"\s*(?:(?P<sign>==|!=|<=|>=|<|>)|(?P<open>[(\[])|(?P<close>[)\]])|(?P<sep>,)|(?P<quoted>'[^']*'|\"[^\"]*\")|(?P<amount>-?[0-9]+(?:[.][0-9]+)?)(?P<unit>[smhdw](?=\s+ago\b))?|(?P<word>[A-Za-z_][\w.-]*))")


class ExpressionError(ValueError):
    """What is wrong with an expression, and where."""


def tokens(text: str) -> list[tuple[str, str, int]]:
    if len(text) > 4000:
        raise ExpressionError("expression is longer than 4000 characters")
    out, at, text = [], 0, text.rstrip()
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise ExpressionError(f"can't read position {at}: {text[at : at + 12]!r}")
        kind = m.lastgroup if m.lastgroup != "unit" else "amount"
        out.append((kind, m.group(kind), m.start(kind)))
        if m.group("unit"):
            out.append(("unit", m.group("unit"), m.start("unit")))
        at = m.end()
    return out


def enriched(steps: DataFrame, traces: DataFrame, detections: DataFrame | None = None) -> DataFrame:
    """Traces with all fields of the language; without detections there is no mode, and expressions that use it are refused by
    the engine."""
    call = F.col("kind") == "tool_call"
    failed = call & F.col("error").isNotNull()
    own = steps.groupBy("trace_id").agg(
        F.coalesce(F.max(F.when(call & (F.col("latency_ms") > 0), F.col("latency_ms"))), F.lit(0)).alias("max_latency"),
        F.count("error").alias("errors"),
        F.collect_set("tool").alias("tools"),
        F.collect_set("agent").alias("agents"),
        F.sort_array(F.collect_list(F.when(failed, F.struct("step_index", "tool")))).getField("tool").alias("failed_tools"),
        F.sort_array(F.collect_set(F.when(failed, F.col("agent")))).alias("failed_agents"),
    )
    out = traces.join(own, "trace_id").withColumn("created", F.col("created_us") / 1e6).withColumnRenamed("n_steps", "steps")
    if detections is None:
        return out
    modes = detections.groupBy("trace_id").agg(F.collect_set("mode_id").alias("mode"))
    return out.join(modes, "trace_id", "left").withColumn("mode", F.coalesce("mode", F.array().cast("array<string>")))


class _Parser:
    def __init__(self, text: str, now: float) -> None:
        self.items, self.at, self.now, self.depth = tokens(text), 0, now, 0

    def peek(self, *words: str) -> bool:
        return self.at < len(self.items) and self.items[self.at][0] == "word" and self.items[self.at][1].lower() in words

    def take(self, kind: str | None = None) -> tuple[str, str, int]:
        if self.at >= len(self.items):
            raise ExpressionError("expression ends too early")
        item = self.items[self.at]
        if kind and item[0] != kind:
            raise ExpressionError(f"{kind} expected at position {item[2]}, not {item[1]!r}")
        self.at += 1
        return item

    def whole(self) -> Column:
        out = self.either()
        if self.at < len(self.items):
            raise ExpressionError(f"unexpected {self.items[self.at][1]!r} at position {self.items[self.at][2]}")
        return out

    def either(self) -> Column:
        out = self.all_of()
        while self.peek("or"):
            self.take()
            out = out | self.all_of()
        return out

    def all_of(self) -> Column:
        out = self.negated()
        while self.peek("and"):
            self.take()
            out = out & self.negated()
        return out

    def negated(self) -> Column:
        if self.peek("not"):
            self.take()
            return ~self.negated()
        if self.at < len(self.items) and self.items[self.at][:2] == ("open", "("):
            self.take()
            self.depth += 1
            if self.depth > 50:
                raise ExpressionError("more than 50 parentheses")
            out = self.either()
            if self.take("close")[1] != ")":
                raise ExpressionError("unmatched bracket")
            self.depth -= 1
            return out
        return self.comparison()

    def comparison(self) -> Column:
        _, name, at = self.take("word")
        if name not in SCALARS and name not in SETS and name not in LISTS:
            raise ExpressionError(f"unknown field {name!r} at position {at}")
        kind, op, at = self.take()
        op = op.lower()
        if kind != "sign" and op not in ("in", "matches", "endswith", "startswith", "contains"):
            raise ExpressionError(f"operator expected at position {at}")
        return compare(name, op, self.value(name))

    def value(self, name: str) -> Any:
        kind, text, at = self.take()
        if (kind, text) == ("open", "["):
            out = []
            while self.items[self.at : self.at + 1] and self.items[self.at][:2] != ("close", "]"):
                out.append(self.value(name))
                if self.items[self.at : self.at + 1] and self.items[self.at][0] == "sep":
                    self.take()
            self.take("close")
            return out
        if kind == "quoted":
            return text[1:-1]
        if kind == "amount":
            if self.items[self.at : self.at + 1] and self.items[self.at][0] == "unit":
                unit = self.take()[1]
                self.take("word")
                if name != "created":
                    raise ExpressionError(f"only created takes a time, not {name}")
                return self.now - float(text) * UNITS[unit]
            return float(text) if "." in text else int(text)
        if kind == "word":
            return {"true": True, "false": False, "none": None}.get(text.lower(), text)
        raise ExpressionError(f"value expected at position {at}")


def _alike(name: str, value: Any) -> bool:
    return isinstance(value, str) if name in TEXTS else isinstance(value, (int, float))


def compare(name: str, op: str, value: Any) -> Column:
    if op == "matches":
        if not isinstance(value, str) or len(value) > 256:
            raise ExpressionError("a pattern of at most 256 characters is expected")
        try:
            re.compile(value)
        except re.error as e:
            raise ExpressionError(f"bad pattern: {e}") from None
    no, yes = F.lit(False), F.lit(True)
    if name in SETS or name in LISTS:
        c = F.coalesce(F.col(name), F.array().cast("array<string>"))
        if op == "contains" and name in SETS:
            wanted = value if isinstance(value, list) else [value]
            return F.forall(F.array(*map(F.lit, map(str, wanted))), lambda x: F.array_contains(c, x)) if wanted else yes
        if op == "in" and isinstance(value, list):
            return F.arrays_overlap(c, F.array(*map(F.lit, map(str, value)))) if value else no
        text = F.when(F.size(c) > 0, F.concat(F.lit("['"), F.array_join(c, "', '"), F.lit("']"))).otherwise("")
        return {"contains": lambda: F.contains(text, F.lit(str(value))), "startswith": lambda: F.startswith(text, F.lit(str(value))), "endswith": lambda: F.endswith(text, F.lit(str(value))), "matches": lambda: F.substring(text, 1, 4096).rlike(value), "!=": lambda: yes}.get(op, lambda: no)()
    c = F.col(SCALARS[name])
    if name == "success" and op in ("<", "<=", ">", ">=") and _alike(name, value):
        c = c.cast("int")
        value = float(value)
    if op in ("==", "!="):
        if value is None:
            same = c.isNull()
        elif isinstance(value, list) or not _alike(name, value):
            same = no
        elif name == "success":
            same = c.eqNullSafe(F.lit(bool(value))) if value in (0, 1) else no
        else:
            same = c.eqNullSafe(F.lit(value if isinstance(value, str) else float(value) if isinstance(value, float) else int(value)))
        return same if op == "==" else ~same
    if op in ("<", "<=", ">", ">="):
        if value is None or isinstance(value, list) or not _alike(name, value):
            return no
        value = F.lit(value)
        return F.coalesce({"<": c < value, "<=": c <= value, ">": c > value, ">=": c >= value}[op], no)
    if op == "in":
        values = value if isinstance(value, list) else [value]
        out = no
        for v in values:
            out = out | compare(name, "==", v)
        return out
    text = F.coalesce(c.cast("string"), F.lit("")) if name != "success" else F.when(c, "True").otherwise("")
    return {"contains": lambda: F.contains(text, F.lit(str(value))), "startswith": lambda: F.startswith(text, F.lit(str(value))), "endswith": lambda: F.endswith(text, F.lit(str(value))), "matches": lambda: F.substring(text, 1, 4096).rlike(value)}[op]()


def compile_expression(text: str, now: float | None = None) -> Column:
    """The expression as a condition on enriched() traces. now: seconds, for times like `24h ago`."""
    return _Parser(text, time.time() if now is None else now).whole()
