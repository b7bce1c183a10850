"""Lowers LogsQL to a lazy DataFrame.

A query begins on typed columns (ts in µs, seq, level, message, metadata as JSON), where time, level and message filters reach the scan. The first
pipe that changes rows turns each into a map from dotted path to JSON token (functions.tokens).
"""

from __future__ import annotations

import ipaddress
import re
from dataclasses import dataclass, field, replace

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, MapType, StringType

from tellurion.errors import QueryError, UnsupportedError
from tellurion.functions import labels as L, tokens as T
from tellurion.plans import logsql as P

WORD = r"[\p{L}\p{Nd}_]"
SOURCE = ("ts", "seq", "level", "message", "metadata")
NUMERIC = r"^(BIGINT|DOUBLE|FLOAT|DECIMAL\(.*\))$"
FIXED = ("_time", "_msg", "level")
PLACEHOLDERS = {
    "N": r"\d+", "UUID": r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}", "IP4": r"\d{1,3}(?:\.\d{1,3}){3}", "TIME": r"\d\d:\d\d:\d\d(?:[.,]\d+)?",
    "DATE": r"\d{4}[-/]\d\d[-/]\d\d", "DATETIME": r"\d{4}[-/]\d\d[-/]\d\d[T ]\d\d:\d\d:\d\d(?:[.,]\d+)?(?:Z|[+-]\d\d:?\d\d)?", "W": WORD + "+",
}


@dataclass
class Rows:
    df: DataFrame
    typed: bool = True
    order: list[tuple[Column, bool]] = field(default_factory=lambda: [(F.col("ts"), False), (F.col("seq"), False)])  # True: descending
    read: dict[str, str] = field(default_factory=dict)  # of fields of typed rows: the column that has their JSON type and text

    @property
    def sort(self) -> list[Column]:
        return [c.desc() if down else c.asc() for c, down in self.order]

    def token(self, name: str) -> Column:
        if not self.typed:
            return F.try_element_at(F.col("row"), F.lit(name))
        if name in FIXED:
            return T.quote(self.text(name))
        value = self._value(name)
        return F.when(self._kind(name) == "STRING", T.quote(value)).when(self._kind(name) == "VOID", "null").otherwise(value)

    def _kind(self, name: str) -> Column:
        """The JSON type. The metadata are parsed once a row, into the column that start() adds."""
        if name in self.read:
            return F.col(f"{self.read[name]}.kind")
        parsed = F.col("variant") if "variant" in self.df.columns else F.try_parse_json("metadata")
        return F.schema_of_variant(F.try_variant_get(parsed, path(name), "variant"))

    def _value(self, name: str) -> Column:
        return F.col(f"{self.read[name]}.value") if name in self.read else F.get_json_object("metadata", path(name))

    def reading(self, names: list[str]) -> Rows:
        """The same rows, for filters on those fields: their JSON is read once a row."""
        new = [n for n in dict.fromkeys(names) if self.typed and n not in FIXED and n not in self.read]
        if not new:
            return self
        read = {n: f"__read{len(self.read) + i}" for i, n in enumerate(new)}
        found = {c: F.struct(self._kind(n).alias("kind"), self._value(n).alias("value")) for n, c in read.items()}
        return replace(self, df=self.df.select("*", once(found)), read=self.read | read)

    def text(self, name: str) -> Column:
        if not self.typed:
            return T.text(self.token(name))
        if name == "_time":
            return T.micros(F.col("ts"))
        if name in ("_msg", "level"):
            return F.coalesce({"_msg": "message", "level": "level"}[name], F.lit(""))
        return F.coalesce(self._value(name), F.lit(""))

    def number(self, name: str) -> Column:
        """A JSON number."""
        if self.typed and name not in FIXED:
            return F.when(self._kind(name).rlike(NUMERIC), self._value(name).try_cast("double"))
        return T.number(self.token(name))

    def words(self, name: str) -> Column:
        """What text filters see: strings alone."""
        if self.typed and name not in FIXED:
            return F.when(self._kind(name) == "STRING", self._value(name))
        return self.text(name) if self.typed else F.when(T.is_string(self.token(name)), self.text(name))

    def mapped(self) -> Rows:
        if not self.typed:
            return self
        rest = F.map_filter(T.flatten(F.col("metadata")), lambda k, v: ~k.isin(*FIXED))
        own = F.map_filter(F.create_map(*[x for n in FIXED for x in (F.lit(n), self.token(n))]), lambda k, v: v.isNotNull())
        return Rows(settled(self.df.select("ts", "seq", F.map_concat(own, rest).alias("row"))), False, self.order)

    def put(self, **values: Column) -> Rows:
        return self.put_all(values)

    def put_all(self, values: dict[str, Column]) -> Rows:
        """Sets tokens; a null one removes the field. A write through an object or into a scalar raises field_conflict."""
        rows = self.mapped()
        # columns of their own, so that a value that is used twice is computed once
        df = rows.df.withColumns({f"__v{i}": v for i, v in enumerate(values.values())})
        names, columns = list(values), [F.col(f"__v{i}") for i in range(len(values))]
        new = F.map_filter(F.create_map(*[x for k, c in zip(names, columns) for x in (F.lit(k), c)]), lambda k, v: v.isNotNull())
        clash = F.exists(F.map_keys("row"), lambda k: _any(k.startswith(n + ".") | F.lit(n).startswith(F.concat(k, F.lit("."))) for n in names))
        kept = F.map_filter("row", lambda k, v: ~k.isin(names))
        row = F.when(clash, F.raise_error(F.lit(f"field_conflict: {', '.join(names)}")).cast("map<string,string>")).otherwise(F.map_concat(kept, new))
        return replace(rows, df=settled(df.withColumn("row", row).drop(*[f"__v{i}" for i in range(len(values))])))

    def set_map(self, row: Column) -> Rows:
        rows = self.mapped()
        return replace(rows, df=rows.df.withColumn("row", row))


def settled(df: DataFrame) -> DataFrame:
    """The same rows, with the map behind a generator: else the optimizer writes the map's expression out wherever a field is read, and plans of a few pipes grow beyond measure."""
    return df.select(*[c for c in df.columns if c != "row"], F.explode(F.array("row")).alias("row"))


def once(columns: dict[str, Column]) -> Column:
    """Those columns, behind a generator: else a filter on them is pushed below and computes them anew wherever it reads one."""
    return F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))


def _any(columns) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | c
    return out


def path(name: str) -> str:
    steps = re.split(r"(?<!\\)\.", name)
    return "$" + "".join(f"['{s.replace(chr(92) + '.', '.')}']" for s in steps)


def literal(text: str) -> str:
    return re.sub(r"([\\.\[\]{}()*+?^$|#\-&~])", r"\\\1", text)


def is_word_char(c: str) -> bool:
    return c == "_" or c.isalpha() or c.isdecimal()


def phrase_pattern(text: str, prefix: bool = False) -> str:
    before = f"(?<!{WORD})" if is_word_char(text[0]) else ""
    after = f"(?!{WORD})" if is_word_char(text[-1]) and not prefix else ""
    return before + literal(text) + after


def phrase(value: Column, text: str, prefix: bool = False) -> Column:
    if text == "":
        return value == "" if not prefix else value != ""
    return value.rlike("(?s)" + phrase_pattern(text, prefix))


def predicate(rows: Rows, node, run) -> Column:
    """Two-valued. `run` evaluates nested queries."""
    match node:
        case P.All():
            return F.lit(True)
        case P.And(items):
            out = F.lit(True)
            for x in items:
                out = out & predicate(rows, x, run)
            return out
        case P.Or(items):
            return _any(predicate(rows, x, run) for x in items)
        case P.Not(item):
            return ~predicate(rows, item, run)
        case P.Time(low, high):
            ts = F.col("ts")
            out = F.lit(True)
            if low is not None:
                out = out & (ts >= low)
            if high is not None:
                out = out & (ts <= high)
            return out if rows.typed else F.coalesce(out, F.lit(False))
        case P.DayRange(low, high, offset):
            of_day = (F.col("ts") * 1000 + offset) % 86_400_000_000_000
            return F.coalesce(of_day.between(low, high), F.lit(False))
        case P.WeekRange(low, high, offset):
            day = F.pmod(F.floor((F.col("ts") * 1000 + offset) / 86_400_000_000_000) + 4, F.lit(7))
            return F.coalesce(day.between(low, high), F.lit(False))
        case P.Match(name, kind, args):
            if name.endswith("*"):
                return field_set(rows, name[:-1], kind, args, run)
            return F.coalesce(matched(rows, name, kind, args, run), F.lit(False))
    raise QueryError(f"unknown filter {node!r}")


def fields_of(node) -> list[str]:
    """The fields that a filter reads by name."""
    match node:
        case P.And(items) | P.Or(items):
            return [n for x in items for n in fields_of(x)]
        case P.Not(item):
            return fields_of(item)
        case P.Match(name, kind, args):
            return [name] * (not name.endswith("*")) + list(args[:1]) * (kind in ("eq_field", "le_field", "lt_field"))
    return []


def field_set(rows: Rows, prefix: str, kind: str, args: tuple, run) -> Column:
    entries = F.map_entries(_row_column(rows))
    fits = F.filter(entries, lambda e: e["key"].startswith(prefix))
    return F.coalesce(F.exists(fits, lambda e: F.coalesce(by_value(T.text(e["value"]), F.when(T.is_string(e["value"]), T.text(e["value"])), e["value"], kind, args), F.lit(False))), F.lit(False))


def _row_column(rows: Rows) -> Column:
    if not rows.typed:
        return F.col("row")
    rest = F.map_filter(T.flatten(F.col("metadata")), lambda k, v: ~k.isin(*FIXED))
    return F.map_concat(F.create_map(*[x for n in FIXED for x in (F.lit(n), rows.token(n))]), rest)


def matched(rows: Rows, name: str, kind: str, args: tuple, run) -> Column:
    if kind in ("in_query", "contains_any_query", "contains_all_query"):
        values = run.values(args[0])
        return by_value(rows.text(name), rows.words(name), rows.token(name), kind.removesuffix("_query"), values)
    if kind in ("eq_field", "le_field", "lt_field"):
        a, b = rows.text(name), rows.text(args[0])
        if kind == "eq_field":
            return a == b
        x, y = T.measure(a), T.measure(b)
        less = (lambda p, q: p <= q) if kind == "le_field" else (lambda p, q: p < q)
        return F.when(x.isNotNull() & y.isNotNull(), less(x, y)).otherwise(less(a, b))
    if rows.typed and kind == "exact" and name == "level":
        return F.col("level") == args[0]
    typed = kind in ("typed", "compare", "range", "value_type", "json_array_contains_any")
    return by_value(rows.text(name), rows.words(name), rows.token(name) if typed else None, kind, args)


def by_value(text: Column, words: Column, token: Column | None, kind: str, args: tuple) -> Column:
    some = args[0] if args else ""
    match kind:
        case "any":
            return text != ""
        case "empty":
            return text == ""
        case "phrase":
            return phrase(words, some)
        case "prefix":
            return phrase(words, some, True)
        case "substring":
            return words.contains(some)
        case "regexp":
            return words.rlike("(?s)" + L.java_regex(some))
        case "i":
            return phrase(F.lower(words), some.lower())
        case "i_prefix":
            return phrase(F.lower(words), some.lower(), True)
        case "exact":
            return text == some
        case "exact_prefix":
            return text.startswith(some)
        case "typed":
            value, quoted = args
            if quoted:
                return (text == value) & T.is_string(token)
            return token == value
        case "in":
            return F.lit(True) if None in args else text.isin(*args) if args else F.lit(False)
        case "contains_all":
            out = F.lit(True)
            for x in args:
                out = out & (F.lit(True) if x is None else phrase(words, x))
            return out
        case "contains_any":
            return _any(F.lit(True) if x is None else phrase(words, x) for x in args)
        case "json_array_contains_any":
            items = F.from_json(F.when(text.startswith("["), text), "array<string>")
            return F.arrays_overlap(items, F.array(*[F.lit(x) for x in args]))
        case "compare":
            op, wanted = args
            return _compare(token, op, wanted)
        case "range":
            low, high, left, right = args
            return _compare(token, ">=" if left else ">", low) & _compare(token, "<=" if right else "<", high)
        case "ipv4_range":
            low, high = ip_bounds(args, 4)
            return T.ipv4(text).between(low, high)
        case "ipv6_range":
            low, high = ip_bounds(args, 6)
            return ipv6_hex(text).between(f"{low:032x}", f"{high:032x}")
        case "string_range":
            return (text >= some) & (text < args[1])
        case "len_range":
            return F.char_length(text).between(int(some), 2**31 - 1 if args[1].lower() in ("inf", "+inf") else int(args[1]))
        case "value_type":
            return value_type(token, some)
        case "seq":
            return words.rlike("(?s)" + ".*?".join(phrase_pattern(x) for x in args))
        case "pattern_match" | "pattern_match_full" | "pattern_match_prefix" | "pattern_match_suffix":
            body = "".join(PLACEHOLDERS[m[1:-1]] if re.fullmatch(r"<(N|UUID|IP4|TIME|DATE|DATETIME|W)>", m) else literal(m) for m in re.split(r"(<(?:N|UUID|IP4|TIME|DATE|DATETIME|W)>)", some))
            return words.rlike("(?s)" + (r"\A" if kind.endswith(("full", "prefix")) else "") + body + (r"\z" if kind.endswith(("full", "suffix")) else ""))
    raise QueryError(f"unknown filter {kind}")


def _compare(token: Column, op: str, wanted) -> Column:
    ops = {"<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b}[op]
    if isinstance(wanted, int):
        exact = T.integer(token)
        return F.when(exact.isNotNull(), ops(exact, F.lit(str(wanted)).cast("decimal(38,0)"))).otherwise(ops(T.number(token), F.lit(float(wanted))))
    return ops(T.number(token), F.lit(float(wanted)))


def ip_bounds(args: tuple, version: int) -> tuple[int, int]:
    try:
        if len(args) == 2:
            return tuple(int(ipaddress.ip_address(x)) for x in args)  # type: ignore[return-value]
        net = ipaddress.ip_network(args[0], strict=False)
    except ValueError as e:
        raise QueryError(str(e)) from None
    return int(net.network_address), int(net.broadcast_address)


@F.pandas_udf(StringType())
def ipv6_hex(text: pd.Series) -> pd.Series:
    def one(x):
        try:
            a = ipaddress.ip_address(x)
        except ValueError:
            return None
        return f"{int(a):032x}" if a.version == 6 else f"{int(a) | 0xFFFF00000000:032x}"

    return text.map(one)


def value_type(token: Column, kind: str) -> Column:
    whole = token.rlike(r"^-?\d+$")
    table = {
        "string": T.is_string(token), "uint64": whole & ~token.startswith("-"), "int64": whole & token.startswith("-"), "float64": token.rlike(T.NUMBER) & ~whole, "number": token.rlike(T.NUMBER),
        "bool": token.isin("true", "false"), "null": token == "null", "array": token.startswith("["), "object": token.startswith("{"),
    }
    if kind not in table:
        raise QueryError(f"unknown value type {kind!r}")
    return table[kind]


class Run:
    def __init__(self, source: DataFrame, now: int, most_values: int = 100_000):
        self.source, self.now, self.most_values = source, now, most_values
        self.global_filter = None

    def start(self, query: P.Query) -> Rows:
        df = self.source
        if "seq" not in df.columns:
            df = df.withColumn("seq", F.lit(0).cast("long"))
        rows = Rows(df.select(*SOURCE, F.try_parse_json("metadata").alias("variant")))
        offset = query.options.get("time_offset")
        if offset:
            rows = replace(rows, df=rows.df.withColumn("ts", F.col("ts") + offset))
        given = query.options.get("global_filter", self.global_filter)
        for f in [query.filter] + [given] * (given is not None):
            rows = self.do_filter(rows, f)
        return rows

    def query(self, query: P.Query) -> Rows:
        if "global_filter" in query.options:
            self.global_filter = query.options["global_filter"]
        rows = self.start(query)
        for pipe in query.pipes:
            rows = getattr(self, "do_" + pipe.name)(rows, **{k.replace("if", "condition") if k == "if" else k + "_" if k in ("as", "from") else k: v for k, v in pipe.args.items()})
        return rows

    def values(self, query: P.Query) -> tuple:
        """Of a nested query's last field, at most most_values come to the driver; more are an error."""
        last = query.pipes[-1]
        names = last.args.get("fields") or [s.alias for s in last.args.get("stats", ())] or last.args.get("by") or []
        if len(names) != 1:
            raise QueryError("a nested query names one field")
        rows = self.query(query)
        found = rows.df.select(rows.text(names[0]).alias("x")).distinct().limit(self.most_values + 1).collect()
        if len(found) > self.most_values:
            raise QueryError("a nested query gives too many values")
        return tuple(sorted(r["x"] for r in found))

    def when(self, rows: Rows, condition) -> Column:
        return predicate(rows, condition, self) if condition is not None else F.lit(True)

    # rows
    def do_filter(self, rows: Rows, filter) -> Rows:
        rows = rows.reading(fields_of(filter))
        return replace(rows, df=rows.df.where(predicate(rows, filter, self)))

    def do_limit(self, rows: Rows, n: int) -> Rows:
        return replace(rows, df=rows.df.orderBy(*rows.sort).limit(n))

    def do_offset(self, rows: Rows, n: int) -> Rows:
        return replace(rows, df=rows.df.orderBy(*rows.sort).offset(n))

    def keys(self, rows: Rows, by: list[tuple[str, bool]], flip: bool = False) -> list[tuple[Column, bool]]:
        out = [(F.col("ts") if name == "_time" and rows.typed else T.natural(rows.text(name)), down != flip) for name, down in by]
        return out + [(c, down != flip) for c, down in rows.order]

    def do_sort(self, rows: Rows, by, desc=False, limit=None, offset=None, partition=None, rank=None) -> Rows:
        keys = self.keys(rows, by or [("_time", False)], desc)
        if partition:
            rows = self._first(rows, limit or 2**31 - 1, keys, partition, rank)
            return rows
        if rank:
            rows = self._first(rows, limit or 2**31 - 1, keys, [], rank)
        if not rank:
            rows = replace(rows, order=keys)
        df = rows.df.orderBy(*rows.sort)
        df = df.offset(offset) if offset else df
        return replace(rows, df=df.limit(limit) if limit else df)

    def _first(self, rows: Rows, n: int, keys: list[tuple[Column, bool]], partition: list[str], rank: str | None) -> Rows:
        rows = replace(rows, order=keys)
        own = Window.partitionBy(*([rows.text(p) for p in partition] or [F.lit(0)])).orderBy(*rows.sort)
        df = rows.df.withColumn("__rank", F.row_number().over(own)).where(F.col("__rank") <= n)
        rows = replace(rows, df=df)
        if rank:
            rows = _ranked(rows, rank)
        group = [(T.natural(rows.text(p)), False) for p in partition]
        return replace(rows, df=rows.df.drop("__rank"), order=group + rows.order if partition else rows.order)

    def do_first(self, rows: Rows, n: int, by=None, partition=None, rank=None) -> Rows:
        return self._edge(rows, n, by, partition, rank, False)

    def do_last(self, rows: Rows, n: int, by=None, partition=None, rank=None) -> Rows:
        return self._edge(rows, n, by, partition, rank, True)

    def _edge(self, rows: Rows, n, by, partition, rank, flip) -> Rows:
        keys = self.keys(rows, by or [("_time", False)], flip)
        if not partition and not rank:
            rows = replace(rows, order=keys)
            return replace(rows, df=rows.df.orderBy(*rows.sort).limit(n))
        return self._first(rows, n, keys, partition or [], rank)

    def do_sample(self, rows: Rows, n: int) -> Rows:
        return replace(rows, df=rows.df.where(F.rand() < 1.0 / max(1, n)))

    def do_field_values(self, rows: Rows, field: str, filter=None, limit=None) -> Rows:
        return self.do_uniq(rows, by=[field], filter=filter, hits="hits", limit=limit)

    def do_field_names(self, rows: Rows, as_: str = "name") -> Rows:
        names = rows.mapped().df.select(F.explode(F.array_distinct(F.transform(F.map_keys("row"), lambda k: F.split_part(k, F.lit("."), F.lit(1))))).alias("k"))
        found = names.groupBy("k").agg(F.count("*").alias("n"))
        return table(found, {as_: T.quote(F.col("k")), "hits": F.col("n").cast("string")}, [F.col("k")])

    def do_fields(self, rows: Rows, fields: list[str]) -> Rows:
        if fields == ["*"]:
            return rows
        return rows.set_map(F.map_filter(F.col("row"), lambda k, v: _any(named(k, f) for f in fields)))

    def do_delete(self, rows: Rows, fields: list[str]) -> Rows:
        return rows.set_map(F.map_filter(F.col("row"), lambda k, v: ~_any(named(k, f) for f in fields)))

    def do_copy(self, rows: Rows, pairs) -> Rows:
        return self._move(rows, pairs, False)

    def do_rename(self, rows: Rows, pairs) -> Rows:
        return self._move(rows, pairs, True)

    def _move(self, rows: Rows, pairs, remove: bool) -> Rows:
        rows = rows.mapped()
        for a, b in pairs:
            stem, into = a.rstrip("*"), b.rstrip("*")
            fits = starting(stem) if a.endswith("*") else below(stem)
            moved = F.transform_keys(F.map_filter("row", fits), renamed(stem, into))
            rest = F.map_filter("row", negated(fits)) if remove else F.col("row")
            df = rows.df.withColumn("__moved", moved).withColumn("row", rest)
            df = df.withColumn("row", F.map_concat(F.map_filter("row", lambda k, v: ~F.array_contains(F.map_keys("__moved"), k)), F.col("__moved"))).drop("__moved")
            rows = replace(rows, df=df)
        return rows

    # groups
    def do_stats(self, rows: Rows, by: list[str], stats: list[P.Stat]) -> Rows:
        keyed = rows.df
        for i, name in enumerate(by):
            keyed = keyed.withColumn(f"__k{i}", rows.token(name))
        inner = replace(rows, df=keyed)
        keys = [f"__k{i}" for i in range(len(by))]
        apart = {i: found for i, s in enumerate(stats) if (found := self.counted(inner, s, keys)) is not None}
        columns = [self.stat(inner, s).alias(f"__s{i}") for i, s in enumerate(stats) if i not in apart] or [F.lit(0).alias("__none")]
        grouped = keyed.groupBy(*keys).agg(*columns) if keys else keyed.agg(*columns)
        for i, (found, missing) in apart.items():
            found = found.select(*[F.col(k).alias(f"__other{k}") for k in keys], F.col("value").alias(f"__s{i}"))
            if keys:
                grouped = grouped.join(found, [grouped[k].eqNullSafe(found[f"__other{k}"]) for k in keys], "left").drop(*[f"__other{k}" for k in keys])
            else:
                grouped = grouped.join(F.broadcast(found), how="left")  # one row each
            grouped = grouped.withColumn(f"__s{i}", F.coalesce(f"__s{i}", F.lit(missing)))
        values = {n: F.col(f"__k{i}") for i, n in enumerate(by)} | {s.alias: F.col(f"__s{i}") for i, s in enumerate(stats)}
        return table(grouped, values, [T.text(F.col(k)) for k in keys] or [F.lit(0)])

    def counted(self, rows: Rows, s: P.Stat, keys: list[str]) -> tuple[DataFrame, str] | None:
        """keys and value of a statistic over all values of one field, by how often each value occurs: no group is ever one row. And the token of an empty group."""
        if s.name not in ("histogram", "median", "quantile") or len(s.fields) != 1 or s.fields[0] == "*":
            return None
        f = s.fields[0]
        rows = rows.reading([f] + fields_of(s.condition))
        holds = self.when(rows, s.condition)
        if s.name == "histogram":
            v = rows.number(f)
            several = rows.df.where(holds & v.isNotNull() & ~F.isnan(v) & (v >= 0)).groupBy(*keys, log_bucket(v).alias("__bucket")).agg(F.count("*").alias("__n"))
            item = F.concat(F.lit('{"vmrange":"'), vmrange(F.col("__bucket")), F.lit('","hits":'), F.col("__n").cast("string"), F.lit("}"))
            listed = F.transform(F.array_sort(F.collect_list(F.struct("__bucket", item.alias("j")))), lambda x: x["j"])  # 488 buckets at most
            return several.groupBy(*keys).agg(F.concat(F.lit("["), F.array_join(listed, ","), F.lit("]")).alias("value")), "[]"
        several = rows.df.where(holds & (rows.text(f) != "")).groupBy(*keys, rows.token(f).alias("__token")).agg(F.count("*").alias("__n"))
        own = Window.partitionBy(*keys)
        upto = F.sum("__n").over(own.orderBy(T.natural(T.text(F.col("__token"))), "__token"))
        ranked = several.select(*keys, "__token", upto.alias("__upto"), F.sum("__n").over(own).alias("__all"), T.natural(T.text(F.col("__token"))).alias("__order"))
        at = F.greatest(F.least(F.floor(F.col("__all") * (0.5 if s.name == "median" else s.phi)), F.col("__all") - 1), F.lit(0))
        return ranked.where(F.col("__upto") > at).groupBy(*keys).agg(F.min_by("__token", F.struct("__order", "__token")).alias("value")), '""'

    def stat(self, rows: Rows, s: P.Stat) -> Column:
        """A token."""
        fields = [f for f in s.fields if f != "*"]
        holds = self.when(rows, s.condition)
        only = lambda c: F.when(holds, c)
        filled = _any(rows.text(f) != "" for f in fields) if fields else F.lit(True)
        order = F.struct("ts", "seq") if "ts" in rows.df.columns else F.struct(F.lit(0))
        merged = lambda f: F.flatten(F.collect_list(F.array(*[only(f(n)) for n in fields])))
        live = lambda a: F.filter(a, lambda x: x.isNotNull())
        name = s.name
        if name == "count":
            return F.count_if(holds & filled).cast("string")
        if name == "count_empty":
            return F.count_if(holds & ~filled).cast("string")
        if name in ("count_uniq", "count_uniq_hash"):
            key = F.struct(*[rows.token(f) for f in fields])
            return F.count_distinct(only(F.when(filled, key if name == "count_uniq" else F.xxhash64(key)))).cast("string")
        if name in ("sum", "avg"):
            numbers = [only(rows.number(f)) for f in fields]
            whole = [only(T.integer(rows.token(f)) if not rows.typed else F.when(rows.number(f) == F.floor(rows.number(f)), F.get_json_object("metadata", path(f)).try_cast("decimal(38,0)") if f not in FIXED else None)) for f in fields]
            total = _plus(F.coalesce(F.sum(n), F.lit(0.0)) for n in numbers)
            count = _plus(F.count(n) for n in numbers)
            if name == "avg":
                return F.when(count > 0, T.of_number(F.try_divide(total, count)))
            exact = _plus(F.coalesce(F.sum(w), F.lit(0).cast("decimal(38,0)")) for w in whole)
            all_whole = _plus(F.count(w) for w in whole) == count
            return F.when(count == 0, F.lit("null")).when(all_whole, exact.cast("string")).otherwise(T.of_number(total))
        if name in ("min", "max"):
            pick = F.min if name == "min" else F.max
            best = [pick(only(F.when(rows.text(f) != "", F.struct(T.natural(rows.text(f)).alias("k"), rows.token(f).alias("t"))))) for f in fields]
            one = best[0] if len(best) == 1 else (F.least if name == "min" else F.greatest)(*best)
            return F.coalesce(one["t"], F.lit('""'))
        if name in ("median", "quantile"):
            sorted_ = F.array_sort(live(merged(lambda f: F.when(rows.text(f) != "", F.struct(T.natural(rows.text(f)).alias("k"), rows.token(f).alias("t"))))))
            phi = 0.5 if name == "median" else s.phi
            n = F.size(sorted_)
            return F.when(n > 0, F.element_at(sorted_, F.greatest(F.least(F.floor(n * phi).cast("int"), n - 1), F.lit(0)) + 1)["t"]).otherwise(F.lit('""'))
        if name == "stddev":
            return F.coalesce(T.of_number(F.stddev_pop(only(rows.number(fields[0])))), F.lit("null"))
        if name in ("rate", "rate_sum"):
            seconds = self.interval_seconds()
            value = F.count_if(holds) if name == "rate" else F.coalesce(F.sum(only(rows.number(fields[0]))), F.lit(0.0))
            return T.of_number(value.cast("double") / seconds)
        if name == "sum_len":
            return F.coalesce(_plus(F.sum(only(F.octet_length(rows.text(f)))) for f in fields), F.lit(0)).cast("string")
        if name in ("uniq_values", "values"):
            texts = live(merged(lambda f: F.when(rows.text(f) != "", rows.token(f))) if name == "values" else F.array_distinct(merged(lambda f: F.when(rows.text(f) != "", rows.token(f)))))
            ordered = F.transform(F.array_sort(F.transform(texts, lambda t: F.struct(T.natural(T.text(t)).alias("k"), t.alias("t")))), lambda x: x["t"]) if name == "uniq_values" else texts
            ordered = F.slice(ordered, 1, s.limit) if s.limit else ordered
            return F.concat(F.lit("["), F.array_join(ordered, ","), F.lit("]"))
        if name in ("any", "first", "last"):
            value = only(F.when(rows.text(fields[0]) != "", rows.token(fields[0])))
            return F.coalesce(F.max_by(value, F.when(value.isNotNull(), order)) if name == "last" else F.min_by(value, F.when(value.isNotNull(), order)), F.lit('""'))
        if name in ("field_min", "field_max"):
            target, source = fields
            key = only(F.when(rows.text(target) != "", F.struct(T.natural(rows.text(target)), order)))
            return F.coalesce((F.min_by if name == "field_min" else F.max_by)(F.coalesce(rows.token(source), F.lit('""')), key), F.lit('""'))
        if name in ("row_any", "row_min", "row_max"):
            shown = as_object(_row_column(rows), fields if name == "row_any" else fields[1:])
            key = order if name == "row_any" else F.struct(T.natural(rows.text(fields[0])), order)
            if name != "row_any":
                holds_ = holds & (rows.text(fields[0]) != "")
                key = F.when(holds_, key)
            else:
                key = F.when(holds, key)
            return F.coalesce((F.max_by if name == "row_max" else F.min_by)(shown, key), F.lit("{}"))
        if name == "json_values":
            keys = [T.natural(rows.text(n)) for n, _ in s.sort] or [order]
            item = only(F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)], order.alias("o"), as_object(_row_column(rows), fields).alias("j")))
            listed = F.array_sort(F.collect_list(item))
            listed = F.reverse(listed) if s.sort and s.sort[0][1] else listed
            listed = F.slice(listed, 1, s.limit) if s.limit else listed
            return F.concat(F.lit("["), F.array_join(F.transform(listed, lambda x: x["j"]), ","), F.lit("]"))
        raise QueryError(f"unknown statistic {name}")

    def interval_seconds(self) -> float:
        lows, highs = [], []

        def walk(node) -> None:
            if isinstance(node, P.Time):
                lows.append(node.low)
                highs.append(node.high)
            elif isinstance(node, P.And):
                for x in node.items:
                    walk(x)

        walk(self.root.filter)
        low = max((x for x in lows if x is not None), default=None)
        high = min((x for x in highs if x is not None), default=self.now - 1)
        if low is None:
            raise QueryError("rate needs a time range")
        return max((high - low + 1) / 1_000_000, 1e-6)

    def do_uniq(self, rows: Rows, by: list[str], filter=None, hits=None, limit=None) -> Rows:
        rows = rows.reading(by)
        keyed = rows.df.select(once({f"__k{i}": rows.token(n) for i, n in enumerate(by)}))
        keys = [f"__k{i}" for i in range(len(by))]
        keyed = keyed.where(_any(T.text(F.col(k)) != "" for k in keys))
        if filter:
            keyed = keyed.where(_any(T.text(F.col(k)).contains(filter) for k in keys))
        found = keyed.groupBy(*keys).agg(F.count("*").alias("__n"))
        values = {n: F.col(f"__k{i}") for i, n in enumerate(by)} | ({hits: F.col("__n").cast("string")} if hits else {})
        out = table(found, values, [T.text(F.col(k)) for k in keys])
        if limit:
            # past the limit the counts are no longer known
            ranked = out.df.orderBy(*out.sort).limit(limit + 1)
            more = F.count("*").over(Window.partitionBy(F.lit(0))) > limit
            df = ranked.withColumn("__more", more).withColumn("row", F.when(F.col("__more"), F.transform_values("row", lambda k, v: F.when(k == F.lit(hits or ""), F.lit("0")).otherwise(v))).otherwise(F.col("row"))).drop("__more")
            out = replace(out, df=df.orderBy(*out.sort).limit(limit))
        return out

    def do_top(self, rows: Rows, n: int, by: list[str], hits: str = "hits", rank=None) -> Rows:
        counted = self.do_uniq(rows, by, hits=hits)
        out = replace(counted, order=[(T.text(counted.token(hits)).cast("long"), True), *counted.order])
        df = out.df.orderBy(*out.sort).limit(n)
        out = replace(out, df=df)
        if rank:
            df = df.withColumn("__rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*out.sort)))
            out = _ranked(replace(out, df=df), rank)
            out = replace(out, df=out.df.drop("__rank"))
        return out

    def do_facets(self, rows: Rows, n, max_values_per_field, max_value_len, keep_const_fields) -> Rows:
        pairs = rows.mapped().df.select(F.explode("row").alias("k", "v")).where(T.text(F.col("v")) != "")
        counted = pairs.groupBy("k", "v").agg(F.count("*").alias("n"))
        whole = Window.partitionBy("k")
        kept = counted.withColumn("kinds", F.count("*").over(whole)).withColumn("longest", F.max(F.octet_length(T.text(F.col("v")))).over(whole))
        kept = kept.where((F.col("kinds") <= max_values_per_field) & (F.col("longest") <= max_value_len) & (F.lit(keep_const_fields) | (F.col("kinds") > 1)))
        ranked = kept.withColumn("r", F.row_number().over(whole.orderBy(F.desc("n"), T.text(F.col("v"))))).where(F.col("r") <= n)
        return table(ranked, {"field_name": T.quote(F.col("k")), "field_value": F.col("v"), "hits": F.col("n").cast("string")}, [F.col("k"), -F.col("n"), T.text(F.col("v"))])

    def _windowed(self, rows: Rows, by, stats, offset, running: bool) -> Rows:
        rows = rows.mapped()
        if not running and not by and all(s.name in ("count", "sum", "min", "max") for s in stats):
            return self._totals(rows, stats)
        part = Window.partitionBy(*([rows.text(b) for b in by] or [F.lit(0)]))
        own = part.orderBy(*rows.sort)
        frame = own.rowsBetween(Window.unboundedPreceding, -offset) if running else part
        df, names = rows.df, {}
        for i, s in enumerate(stats):
            f = s.fields[0] if s.fields else None
            number = rows.number(f) if f else F.lit(1.0)
            if s.name == "count":
                value = F.count(F.when(rows.text(f) != "", 1) if f and f != "*" else F.lit(1)).over(frame).cast("string")
            elif s.name == "sum":
                value = T.of_number(F.coalesce(F.sum(number).over(frame), F.lit(0.0)))
            elif s.name in ("min", "max"):
                best = (F.min if s.name == "min" else F.max)(F.when(rows.text(f) != "", F.struct(T.natural(rows.text(f)).alias("k"), rows.token(f).alias("t")))).over(frame)
                value = F.coalesce(best["t"], F.lit('""'))
            else:
                whole = frame if running else own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
                value = F.coalesce((F.first if s.name == "first" else F.last)(F.coalesce(rows.token(f), F.lit('""'))).over(whole), F.lit('""'))
            df = df.withColumn(f"__w{i}", value)
            names[s.alias] = F.col(f"__w{i}")
        out = replace(rows, df=df).put_all(names)
        group = [(T.text(out.token(b)), False) for b in by]
        return replace(out, df=out.df.drop(*[f"__w{i}" for i in range(len(stats))]), order=group + out.order)

    def _totals(self, rows: Rows, stats) -> Rows:
        """Of all rows: one aggregated row goes to each, so no task sees them all."""
        columns = []
        for i, s in enumerate(stats):
            f = s.fields[0] if s.fields else None
            if s.name == "count":
                value = F.count(F.when(rows.text(f) != "", 1) if f and f != "*" else F.lit(1)).cast("string")
            elif s.name == "sum":
                value = T.of_number(F.coalesce(F.sum(rows.number(f)), F.lit(0.0)))
            else:
                best = (F.min if s.name == "min" else F.max)(F.when(rows.text(f) != "", F.struct(T.natural(rows.text(f)).alias("k"), rows.token(f).alias("t"))))
                value = F.coalesce(best["t"], F.lit('""'))
            columns.append(value.alias(f"__w{i}"))
        df = rows.df.crossJoin(F.broadcast(rows.df.agg(*columns)))  # one row
        out = replace(rows, df=df).put_all({s.alias: F.col(f"__w{i}") for i, s in enumerate(stats)})
        return replace(out, df=out.df.drop(*[f"__w{i}" for i in range(len(stats))]))

    def do_running_stats(self, rows: Rows, by, stats, offset=0) -> Rows:
        return self._windowed(rows, by, stats, offset, True)

    def do_total_stats(self, rows: Rows, by, stats, offset=0) -> Rows:
        return self._windowed(rows, by, stats, 0, False)

    # text
    def write(self, rows: Rows, name: str, value: Column, condition=None, keep=False, skip=False) -> Rows:
        """A text into a field."""
        rows = rows.mapped()
        rows, value = replace(rows, df=rows.df.withColumn("__text", value)), F.col("__text")
        holds = self.when(rows, condition)
        if keep:
            holds = holds & (rows.text(name) == "")
        if skip:
            holds = holds & (value != "")
        out = rows.put_all({name: F.when(holds, T.quote(value)).otherwise(rows.token(name))})
        return replace(out, df=out.df.drop("__text"))

    def do_coalesce(self, rows: Rows, fields, as_, default="") -> Rows:
        return self.write(rows.mapped(), as_, F.coalesce(*[F.nullif(rows.mapped().text(f), F.lit("")) for f in fields], F.lit(default)))

    def do_format(self, rows: Rows, text, as_="_msg", condition=None, keep_original_fields=False, skip_empty_results=False) -> Rows:
        rows, parts = rows.mapped(), []
        for piece in re.split(r"(<[^<>]*>)", text):
            if re.fullmatch(r"<[^<>]+>", piece):
                option, _, name = piece[1:-1].rpartition(":")
                parts.append(formatted(rows.text(name), option))
            elif piece:
                parts.append(F.lit(piece))
        return self.write(rows, as_, F.concat(*parts) if parts else F.lit(""), condition, keep_original_fields, skip_empty_results)

    def do_math(self, rows: Rows, exprs) -> Rows:
        rows = rows.mapped()
        for expr, alias in exprs:
            value = self.math(rows, expr)
            rows = rows.put_all({alias: F.when(F.isnan(value) | value.isNull(), F.lit('"NaN"')).otherwise(T.of_number(value))})
        return rows

    def math(self, rows: Rows, e) -> Column:
        nan = F.lit(float("nan"))
        match e:
            case ("number", x):
                return F.lit(float(x))
            case ("field", name):
                t = rows.text(name)
                return F.coalesce(T.measure(t), T.ipv4(t).cast("double"), F.when(t.rlike(T.TIME), F.unix_micros(t.try_cast("timestamp")) * 1000.0), nan)
            case ("neg", a):
                return -self.math(rows, a)
            case ("call", "now"):
                return F.lit(self.now * 1000.0)
            case ("call", "rand"):
                return F.rand()
            case ("call", name, *args):
                x = [self.math(rows, a) for a in args]
                if name == "round":
                    near = F.lit(1.0) if len(x) == 1 else x[1]
                    return F.floor(x[0] / near + 0.5).cast("double") * near
                if name in ("max", "min"):
                    return (F.greatest if name == "max" else F.least)(*x) if len(x) > 1 else x[0]
                return {"abs": F.abs, "ceil": lambda v: F.ceil(v).cast("double"), "floor": lambda v: F.floor(v).cast("double"), "exp": F.exp, "ln": lambda v: F.coalesce(F.log(v), nan)}[name](x[0])
            case (op, a, b):
                x, y = self.math(rows, a), self.math(rows, b)
                if op == "default":
                    return F.when(F.isnan(x), y).otherwise(x)
                if op in ("&", "and", "or", "xor"):
                    p, q = x.cast("long"), y.cast("long")
                    return {"&": p.bitwiseAND, "and": p.bitwiseAND, "or": p.bitwiseOR, "xor": p.bitwiseXOR}[op](q).cast("double")
                from tellurion.functions import ieee

                return ieee.arithmetic(x, op, y)
        raise QueryError(f"bad expression {e!r}")

    def do_len(self, rows: Rows, field, as_) -> Rows:
        rows = rows.mapped()
        return rows.put_all({as_: F.octet_length(rows.text(field)).cast("string")})

    def do_hash(self, rows: Rows, field, as_) -> Rows:
        rows = rows.mapped()
        return rows.put_all({as_: hash53(rows.text(field)).cast("string")})

    def do_json_array_len(self, rows: Rows, field, as_) -> Rows:
        rows = rows.mapped()
        t = rows.text(field)
        return rows.put_all({as_: F.coalesce(F.json_array_length(F.when(t.startswith("["), t)), F.lit(0)).cast("string")})

    def do_json_array_concat(self, rows: Rows, text="", from_="_msg", as_=None) -> Rows:
        rows = rows.mapped()
        t = rows.text(from_)
        items = F.from_json(F.when(t.startswith("["), t), "array<string>")
        return self.write(rows, as_ or from_, F.coalesce(F.array_join(items, text), F.lit("")))

    def do_collapse_nums(self, rows: Rows, condition=None, at=None, prettify=False, **_) -> Rows:
        rows, name = rows.mapped(), at or "_msg"
        value = F.regexp_replace(rows.text(name), rf"(?<!{WORD})(0x)?[0-9a-fA-F]*\d[0-9a-fA-F]*(?!{WORD})", "<N>")
        if prettify:
            for old, new in (
                ("<N>-<N>-<N>-<N>-<N>", "<UUID>"), ("<N>\\.<N>\\.<N>\\.<N>", "<IP4>"), ("<N>:<N>:<N>([.,]<N>)?", "<TIME>"), ("<N>[-/]<N>[-/]<N>", "<DATE>"), ("<DATE>[T ]<TIME>(Z|[+-]<N>(:<N>)?)?", "<DATETIME>"),
            ):
                value = F.regexp_replace(value, old, new)
        return self.write(rows, name, value, condition)

    def do_decolorize(self, rows: Rows, field="_msg", as_=None) -> Rows:
        rows = rows.mapped()
        return self.write(rows, as_ or field, F.regexp_replace(rows.text(field), r"\x1B\[[0-?]*[ -/]*[@-~]?", ""))

    def do_drop_empty_fields(self, rows: Rows) -> Rows:
        out = rows.set_map(F.map_filter(F.col("row"), lambda k, v: ~v.isin("null", '""', "{}", "[]")))
        return replace(out, df=out.df.where(F.size("row") > 0))

    def do_replace(self, rows: Rows, old, new, condition=None, at="_msg", limit=None, **_) -> Rows:
        rows = rows.mapped()
        t = rows.text(at)
        if limit:
            pieces = F.split(t, literal(old), limit + 1)
            value = F.array_join(pieces, new)
        else:
            value = F.replace(t, F.lit(old), F.lit(new)) if old else t
        return self.write(rows, at, value, condition)

    def do_replace_regexp(self, rows: Rows, old, new, condition=None, at="_msg", limit=None, **_) -> Rows:
        rows, pattern = rows.mapped(), "(?s)" + L.java_regex(old)
        t = rows.text(at)
        value = replace_some(limit, re.sub(r"\(\?<(?![=!])", "(?P<", pattern), re.sub(r"\$\{?(\w+)\}?", r"\\g<\1>", new))(t) if limit else F.regexp_replace(t, pattern, new)
        return self.write(rows, at, value, condition)

    def do_split(self, rows: Rows, text, from_="_msg", as_=None) -> Rows:
        rows = rows.mapped()
        t = rows.text(from_)
        parts = F.split(t, literal(text)) if text else F.regexp_extract_all(t, F.lit("(?s)(.)"), F.lit(1))
        return rows.put_all({as_ or from_: F.to_json(parts)})

    def do_extract(self, rows: Rows, text, from_="_msg", condition=None, keep_original_fields=False, skip_empty_results=False, **_) -> Rows:
        pieces = re.split(r"<([^<>]*)>", text)
        names, pattern = [], "(?s)" + literal(pieces[0])
        for i in range(1, len(pieces), 2):
            name, after = pieces[i], pieces[i + 1]
            plain, name = name.startswith("plain:"), name.removeprefix("plain:")
            body = ".*?" if after else ".*"
            quoted = "" if plain else r'"(?:\\.|[^"\\])*"|`[^`]*`|'
            if name and name != "_":
                names.append((name, plain))
                pattern += f"({quoted}{body})"
            else:
                pattern += f"(?:{quoted}{body})"
            pattern += literal(after)
        values = {}
        rows = rows.mapped()
        t = rows.text(from_)
        for i, (name, plain) in enumerate(names):
            raw = F.regexp_extract(t, pattern, i + 1)
            decoded = F.coalesce(F.get_json_object(F.concat(F.lit('{"a":'), raw, F.lit("}")), "$.a"), raw)
            value = raw if plain else F.when(raw.rlike(r'^".*"$'), decoded).when(raw.rlike("^`.*`$"), F.substring(raw, F.lit(2), F.length(raw) - 2)).otherwise(raw)
            values[name] = value
        return self.fill(rows, values, condition, keep_original_fields, skip_empty_results)

    def do_extract_regexp(self, rows: Rows, text, from_="_msg", condition=None, keep_original_fields=False, skip_empty_results=False, **_) -> Rows:
        names = list(re.finditer(r"(?<!\\)\((?!\?)|\(\?P?<(\w+)>", text))
        rows, values = rows.mapped(), {}
        for i, m in enumerate(names):
            if m[1]:
                values[m[1]] = F.regexp_extract(rows.text(from_), "(?s)" + L.java_regex(text), i + 1)
        if not values:
            raise QueryError("the expression names no group")
        return self.fill(rows, values, condition, keep_original_fields, skip_empty_results)

    def fill(self, rows: Rows, values: dict[str, Column], condition, keep, skip) -> Rows:
        holds = self.when(rows, condition)
        out = {}
        for name, value in values.items():
            own = holds
            if keep:
                own = own & (rows.text(name) == "")
            if skip:
                own = own & (value != "")
            out[name] = F.when(own, T.quote(value)).otherwise(rows.token(name))
        return rows.put_all(out)

    def merge(self, rows: Rows, found: Column, condition, fields=None, result_prefix="", keep_original_fields=False, skip_empty_results=False) -> Rows:
        """A map of tokens into the row."""
        rows = rows.mapped()
        if fields:
            found = F.map_filter(found, lambda k, v: _any(named(k, f) for f in fields))
        if result_prefix:
            found = F.transform_keys(found, lambda k, v: F.concat(F.lit(result_prefix), k))
        df = rows.df.withColumn("__new", F.when(self.when(rows, condition), F.coalesce(found, F.create_map().cast("map<string,string>"))).otherwise(F.create_map().cast("map<string,string>")))
        if keep_original_fields:
            df = df.withColumn("__new", F.map_filter("__new", lambda k, v: T.text(F.try_element_at("row", k)) == ""))
        if skip_empty_results:
            df = df.withColumn("__new", F.map_filter("__new", lambda k, v: T.text(v) != ""))
        df = df.withColumn("row", F.map_concat(F.map_filter("row", lambda k, v: ~F.array_contains(F.map_keys("__new"), k)), F.col("__new"))).drop("__new")
        return replace(rows, df=df)

    def do_unpack_json(self, rows: Rows, from_="_msg", condition=None, preserve_keys=False, **options) -> Rows:
        rows = rows.mapped()
        t = rows.text(from_)
        return self.merge(rows, T.flatten(F.when(t.startswith("{"), t)), condition, **options)

    def do_unpack_logfmt(self, rows: Rows, from_="_msg", condition=None, **options) -> Rows:
        rows = rows.mapped()
        return self.merge(rows, tokens_of(logfmt(rows.text(from_))), condition, **options)

    def do_unpack_syslog(self, rows: Rows, from_="_msg", condition=None, **options) -> Rows:
        from tellurion.functions.syslog import syslog

        rows = rows.mapped()
        return self.merge(rows, tokens_of(syslog(rows.text(from_))), condition, **options)

    def do_unpack_words(self, rows: Rows, from_="_msg", as_="words", condition=None, drop_duplicates=False, **_) -> Rows:
        rows = rows.mapped()
        found = F.regexp_extract_all(rows.text(from_), F.lit(f"({WORD}+)"), F.lit(1))
        return rows.put_all({as_: F.when(self.when(rows, condition), F.to_json(F.array_distinct(found) if drop_duplicates else found)).otherwise(rows.token(as_))})

    def do_pack_json(self, rows: Rows, fields=None, as_="_msg") -> Rows:
        rows = rows.mapped()
        return rows.put_all({as_: T.quote(as_object(F.col("row"), fields or []))})

    def do_pack_logfmt(self, rows: Rows, fields=None, as_="_msg") -> Rows:
        rows = rows.mapped()
        kept = F.map_filter("row", lambda k, v: _any(named(k, f) for f in fields)) if fields else F.col("row")
        pair = lambda e: F.concat(e["key"], F.lit("="), F.when(T.text(e["value"]).rlike(r'^[^\s"=]*$'), T.text(e["value"])).otherwise(T.quote(T.text(e["value"]))))
        return self.write(rows, as_, F.array_join(F.transform(F.array_sort(F.map_entries(kept)), pair), " "))

    def do_unroll(self, rows: Rows, fields, condition=None) -> Rows:
        rows = rows.mapped()
        holds = self.when(rows, condition)
        df = rows.df.withColumns({"__holds": holds, **{f"__t{i}": rows.text(f) for i, f in enumerate(fields)}})
        lists = {f"__t{i}": F.when(F.col(f"__t{i}").startswith("["), F.from_json(f"__t{i}", "array<string>")).otherwise(F.array(f"__t{i}")) for i in range(len(fields))}
        zipped = F.arrays_zip(*[F.col(f"__t{i}").alias(f"f{i}") for i in range(len(fields))])
        blank = F.array(F.struct(*[F.lit("").alias(f"f{i}") for i in range(len(fields))]))
        df = df.withColumns(lists).withColumn("__z", zipped).drop(*lists)
        df = df.withColumn("__z", F.when(F.size("__z") > 0, F.col("__z")).otherwise(blank))
        df = df.select("*", F.posexplode(F.when(F.col("__holds"), F.col("__z")).otherwise(F.slice("__z", 1, 1))).alias("__at", "__i"))
        out = replace(rows, df=df, order=[*rows.order, (F.col("__at"), False)])
        out = out.put_all({f: F.when(F.col("__holds"), T.quote(F.coalesce(F.col("__i")[f"f{i}"], F.lit("")))).otherwise(rows.token(f)) for i, f in enumerate(fields)})
        return replace(out, df=out.df.drop("__holds", "__z", "__i"))

    def other(self, source) -> Rows:
        if isinstance(source, list):
            spark = self.source.sparkSession
            df = spark.createDataFrame([(i, r) for i, r in enumerate(source)], "n long, r map<string,string>")
            return Rows(df.select(F.lit(None).cast("long").alias("ts"), F.col("n").alias("seq"), F.transform_values("r", lambda k, v: T.quote(v)).alias("row")), False)
        return Run.query(self.child(), source).mapped()

    def child(self) -> Run:
        run = Run(self.source, self.now, self.most_values)
        run.global_filter, run.root = self.global_filter, self.root
        return run

    def do_join(self, rows: Rows, by, source, inner=False, prefix="") -> Rows:
        rows, right = rows.mapped(), self.other(source)
        keys = F.map_filter("row", lambda k, v: ~k.isin(by))
        renamed = F.transform_keys(keys, lambda k, v: F.concat(F.lit(prefix), k)) if prefix else keys
        other = right.df.select(*[right.text(b).alias(f"__r{i}") for i, b in enumerate(by)], renamed.alias("__other"))
        left = rows.df.withColumns({f"__l{i}": rows.text(b) for i, b in enumerate(by)})
        on = [F.col(f"__l{i}") == F.col(f"__r{i}") for i in range(len(by))]
        df = left.join(other, on, "inner" if inner else "left")
        extra = F.map_filter(F.coalesce("__other", F.create_map().cast("map<string,string>")), lambda k, v: T.text(F.try_element_at("row", k)) == "")
        df = df.withColumn("__extra", extra).withColumn("row", F.map_concat(F.map_filter("row", lambda k, v: ~F.array_contains(F.map_keys("__extra"), k)), F.col("__extra")))
        return replace(rows, df=df.drop("__other", "__extra", *[f"__l{i}" for i in range(len(by))], *[f"__r{i}" for i in range(len(by))]))

    def do_union(self, rows: Rows, source) -> Rows:
        a, b = rows.mapped(), self.other(source)
        pick = lambda r, n: r.df.select(F.lit(n).alias("__part"), *[F.col(c) if c in r.df.columns else F.lit(None).cast("long").alias(c) for c in ("ts", "seq")], "row")
        return Rows(pick(a, 0).union(pick(b, 1)), False, [(F.col(c), False) for c in ("__part", "ts", "seq")])

    def do_time_add(self, rows: Rows, ns: int, field="_time") -> Rows:
        rows = rows.mapped()
        t = rows.text(field)
        shifted = T.micros(F.unix_micros(t.try_cast("timestamp")) + ns // 1000)
        out = rows.put_all({field: F.when(t.rlike(T.TIME), T.quote(shifted)).otherwise(rows.token(field))})
        return replace(out, df=out.df.withColumn("ts", F.col("ts") + ns // 1000)) if field == "_time" else out

    def do_generate_sequence(self, rows: Rows, n: int) -> Rows:
        df = self.source.sparkSession.range(n).select(F.lit(None).cast("long").alias("ts"), F.col("id").alias("seq"), F.create_map(F.lit("_msg"), T.quote(F.col("id").cast("string"))).alias("row"))
        return Rows(df, False, [(F.col("seq"), False)])

    def do_set_stream_fields(self, rows: Rows, fields, condition=None) -> Rows:
        rows = rows.mapped()
        kept = F.array_sort(F.map_entries(F.map_filter("row", lambda k, v: _any(named(k, f) for f in fields) & (T.text(v) != ""))))
        value = F.concat(F.lit("{"), F.array_join(F.transform(kept, lambda e: F.concat(e["key"], F.lit("="), T.quote(T.text(e["value"])))), ","), F.lit("}"))
        return self.write(rows, "_stream", value, condition)

    def do_query_stats(self, rows: Rows) -> Rows:
        df = rows.df.agg(F.count("*").alias("n"))
        return table(df, {"rows": F.col("n").cast("string")}, [F.lit(0)])


def _plus(columns) -> Column:
    out = None
    for c in columns:
        out = c if out is None else out + c
    if out is None:
        raise QueryError("the statistic needs a field")
    return out


def _ranked(rows: Rows, name: str) -> Rows:
    return rows.put_all({name: T.quote(F.col("__rank").cast("string"))}) if not rows.typed else _ranked_typed(rows, name)


def _ranked_typed(rows: Rows, name: str) -> Rows:
    row = _row_column(rows)
    df = rows.df.withColumn("row", row).select("ts", "seq", "row", "__rank")
    return _ranked(Rows(df, False, rows.order), name)


def named(key: Column, field: str) -> Column:
    """The field itself, what lies below it, or the set that `prefix*` names."""
    if field == "*":
        return F.lit(True)
    if field.endswith("*"):
        return key.startswith(field[:-1])
    return (key == field) | key.startswith(field + ".")


def starting(stem: str):
    return lambda k, v: k.startswith(stem)


def below(name: str):
    return lambda k, v: named(k, name)


def negated(fits):
    return lambda k, v: ~fits(k, v)


def renamed(stem: str, into: str):
    return lambda k, v: F.concat(F.lit(into), F.substring(k, F.lit(len(stem) + 1), F.length(k)))


def table(df: DataFrame, values: dict[str, Column], order: list[Column]) -> Rows:
    """Rows from columns that hold tokens, in ascending order."""
    row = F.map_filter(F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)]), lambda k, v: v.isNotNull())
    out = df.select(F.lit(None).cast("long").alias("ts"), F.lit(0).cast("long").alias("seq"), row.alias("row"), *[c.alias(f"__o{i}") for i, c in enumerate(order)])
    return Rows(settled(out), False, [(F.col(f"__o{i}"), False) for i in range(len(order))])


def tokens_of(texts: Column) -> Column:
    return F.transform_values(texts, lambda k, v: T.quote(v))


def as_object(row: Column, fields: list[str]) -> Column:
    """The row's fields as a JSON object, names in order."""
    kept = F.map_filter(row, lambda k, v: v.isNotNull() & (_any(named(k, f) for f in fields) if fields else F.lit(True)))
    return F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.map_entries(kept)), lambda e: F.concat(T.quote(e["key"]), F.lit(":"), e["value"])), ","), F.lit("}"))


def formatted(t: Column, option: str) -> Column:
    number = t.try_cast("double")
    table_ = {
        "": lambda: t, "uc": lambda: F.upper(t), "lc": lambda: F.lower(t), "q": lambda: T.quote(t), "urlencode": lambda: F.url_encode(t), "urldecode": lambda: F.try_url_decode(t),
        "url": lambda: F.url_encode(t), "hexencode": lambda: F.hex(t.cast("binary")), "hex": lambda: F.hex(t.cast("binary")), "hexdecode": lambda: F.unhex(t).cast("string"), "base64encode": lambda: F.base64(t.cast("binary")),
        "base64": lambda: F.base64(t.cast("binary")), "base64decode": lambda: F.try_to_binary(t, F.lit("base64")).cast("string"), "hexnumencode": lambda: F.lpad(F.hex(number.cast("long")), 16, "0"), "hexnum": lambda: F.lpad(F.hex(number.cast("long")), 16, "0"),
        "hexnumdecode": lambda: F.conv(t, 16, 10), "time": lambda: T.micros((number / 1000).cast("long")), "duration": lambda: duration_text(number / 1e9), "duration_seconds": lambda: T.of_number(T.measure(t) / 1e9),
        "ipv4": lambda: F.concat_ws(".", *[F.shiftright(number.cast("long"), s).bitwiseAND(255).cast("string") for s in (24, 16, 8, 0)]),
    }
    if option not in table_:
        raise QueryError(f"unknown format option {option!r}")
    return F.coalesce(table_[option](), t)


def duration_text(seconds: Column) -> Column:
    h, m = F.floor(seconds / 3600), F.floor(F.pmod(seconds, F.lit(3600.0)) / 60)
    s = F.pmod(seconds, F.lit(60.0))
    return F.concat(F.when(h > 0, F.concat(h.cast("string"), F.lit("h"))).otherwise(""), F.when((h > 0) | (m > 0), F.concat(m.cast("string"), F.lit("m"))).otherwise(""), T.of_number(F.round(s, 9)), F.lit("s"))


def log_bucket(v: Column) -> Column:
    """18 a decade: -1 below 1e-9, 486 above 1e18."""
    return F.when(v < 1e-9, -1).when(v > 1e18, 486).otherwise(F.greatest(F.ceil(F.log10(v) * 18 + 162).cast("int") - 1, F.lit(0)))


def vmrange(i: Column) -> Column:
    edge = lambda k: F.format_string("%.3e", F.pow(F.lit(10.0), (k - 162) / 18.0))
    return F.when(i == -1, "0...1.000e-09").when(i == 486, "1.000e+18...+Inf").otherwise(F.concat(edge(i), F.lit("..."), edge(i + 1)))


@F.pandas_udf(LongType())
def hash53(text: pd.Series) -> pd.Series:
    return text.map(lambda x: xxhash.xxh64_intdigest(x.encode(), 0) & ((1 << 53) - 1))


def replace_some(limit: int, pattern: str, new: str):
    @F.pandas_udf(StringType())
    def run(text: pd.Series) -> pd.Series:
        found = re.compile(pattern)
        return text.map(lambda x: found.sub(new, x, count=limit))

    return run


@F.pandas_udf(MapType(StringType(), StringType()))
def logfmt(text: pd.Series) -> pd.Series:
    import json

    pair = re.compile(r'([^\s=]+)(?:=("(?:\\.|[^"\\])*"|\S*))?')

    def value(raw: str | None) -> str:
        if raw and raw[0] == '"' and len(raw) > 1 and raw[-1] == '"':
            try:
                return json.loads(raw)
            except ValueError:
                return raw
        return raw or ""

    return text.map(lambda x: {m[1]: value(m[2]) for m in pair.finditer(x)})


def run(source: DataFrame, text: str, now: int) -> Rows:
    query = P.parse(text, now)
    r = Run(source, now)
    r.root = query
    return r.query(query)


__all__ = ["Rows", "UnsupportedError", "run"]
