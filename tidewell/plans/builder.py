"""From a statement's tree to a DataFrame.

One builder serves both modes. In table mode the result is the final state of the materialised view;
in pipeline mode it is all that the pipeline would have emitted over the bounded input. Catalyst does
the rest: filters, projections and joins are declared, never scheduled.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewell.functions import registry as R
from tidewell.functions import values as V
from tidewell.functions.registry import Typed
from tidewell.operators import joins as J
from tidewell.operators import lateness, latest, windows
from tidewell.sql import tree as S
from tidewell.sql.parser import parse
from tidewell.sql.tree import DialectError

META = ("_ts", "_source")


@dataclass
class Relation:
    """Columns by their own names, then _ts and _source."""

    df: DataFrame
    fields: list[tuple[str, str]]
    #: Of a windowed query: its window, whose end is in _ts.
    window: S.Window | None = None
    #: Says whether rows are grouped; a scalar subquery must be.
    grouped: bool = False


def q(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


@dataclass
class Frame:
    """A row set while a SELECT is built: physical columns are alias.name, and __ts is the row's time."""

    df: DataFrame
    scope: dict[str, dict[str, tuple[str, str]]] = field(default_factory=dict)
    order: list[tuple[str, list[str]]] = field(default_factory=list)
    #: Columns that stand for subqueries.
    extra: dict[object, tuple[str, str]] = field(default_factory=dict)

    def find(self, name: S.Name) -> tuple[str, str]:
        key = name.column.lower()
        if name.alias is not None:
            if name.alias not in self.scope:
                raise DialectError(f"unknown alias {name.alias}", *name.pos)
            hit = self.scope[name.alias].get(key)
            if hit is None:
                raise DialectError(f"unknown column {name.alias}.{name.column}", *name.pos)
            return hit
        hits = [s[key] for s in self.scope.values() if key in s]
        if key in META:
            return hits[0]
        if len(hits) > 1:
            raise DialectError(f"column {name.column} is ambiguous", *name.pos)
        if not hits:
            if name.column in self.scope and "" in self.scope[name.column]:  # an UNNEST alias is its element
                return self.scope[name.column][""]
            raise DialectError(f"unknown column {name.column}", *name.pos)
        return hits[0]


class Session:
    """Sources by name, and statements over them."""

    def __init__(self, spark: SparkSession, scalar_null_pad: bool = False, identity: str = "columns"):
        """scalar_null_pad: in table mode, an outer row without a match keeps a NULL (SQL) instead of going.
        identity: "columns", or "event" for a UNION whose equal rows with different event times stay apart."""
        self.spark, self.scalar_null_pad, self.identity = spark, scalar_null_pad, identity
        self.relations: dict[str, Relation] = {}

    def register(self, name: str, df: DataFrame, ts: str | Column | None = None, json: tuple[str, ...] = (), arrival: str | None = None) -> Session:
        """A stream or table. ts gives the event time: a timestamp or epoch milliseconds; json names text columns
        that hold JSON; arrival names a number that tells the order of arrival, which breaks ties of time. Sources with
        arrivals number them together; a pipeline drops their late events before anything else, by one watermark over all
        sources of the statement. A source without is taken to be in order."""
        fields, columns = [], []
        for f in df.schema.fields:
            if f.name in META:
                continue
            kind = V.JSON if f.name in json else V.kind_of(f.dataType)
            fields.append((f.name, kind))
            columns.append(V.narrow(q(f.name), f.dataType).alias(f.name))
        time = q("_ts") if ts is None and "_ts" in df.columns else F.lit(0) if ts is None else q(ts) if isinstance(ts, str) else ts
        if isinstance(ts, str):
            time = V.narrow(time, df.schema[ts].dataType)
        source = q("_source").cast("string") if "_source" in df.columns else F.lit(name)
        order = [q(arrival).cast("bigint").alias("_arrival")] if arrival else []
        self.relations[name] = Relation(df.select(*columns, *order, time.cast("bigint").alias("_ts"), source.alias("_source")), fields)
        return self

    def compile(self, text: str, mode: str = "table") -> Relation:
        return Builder(self, mode, references(text)).query(parse(text))

    def sql(self, text: str, mode: str = "table") -> DataFrame:
        """The statement's columns; a windowed one ends with window_start and window_end, and with _final under EMIT CHANGES."""
        r = self.compile(text, mode)
        return r.df.select(*[q(n) for n, _ in r.fields])

    def stream(self, text: str, mode: str = "pipeline") -> DataFrame:
        """The statement over sources whose DataFrames stream, to be written in append mode (LATEST BY, in table mode: update).

        Scans, filters, projections, UNION ALL, one window, interval joins and LATEST BY run as streams. The watermark is
        Spark's: one for all inputs, advanced after each batch; drivers.StrictLateness drops late events exactly.
        """
        from tidewell.streaming import drivers

        drivers.one_watermark(self.spark)
        return self.sql(text, mode)

    def define(self, name: str, text: str, mode: str = "table") -> Session:
        """A statement whose output is a source for others."""
        r = self.compile(text, mode)
        self.relations[name] = Relation(r.df.withColumn("_source", F.lit(name)), r.fields)
        return self


def references(text: str) -> list[str]:
    """Names that a statement reads, CTEs not among them, each once in reading order."""
    out: list[str] = []

    def visit(node):
        match node:
            case S.Source():
                if node.name not in out:
                    out.append(node.name)
            case S.Derived():
                visit(node.query)
            case S.Union():
                for b in node.branches:
                    visit(b)
            case S.Select():
                exprs = [*(i.expr for i in node.items), node.where, *node.group_by, *node.latest_by]
                visit(node.source)
                for j in node.joins:
                    visit(j.source)
                    exprs.append(j.on)
                for e in exprs:
                    for x in S.walk(e):
                        if isinstance(x, (S.InQuery, S.Exists, S.ScalarQuery)):
                            visit(x.query)

    visit(parse(text))
    return out


def summary(text: str) -> str:
    """The plan in one line."""

    def show(node) -> str:
        match node:
            case S.Source():
                return f"scan {node.name}"
            case S.Derived():
                return f"({show(node.query)})"
            case S.Unnest():
                return "unnest"
            case S.Union():
                return (" union " if node.distinct else " union all ").join(show(b) for b in node.branches)
        parts = [show(node.source)]
        parts += [f"{j.kind} join {show(j.source)}" + (f" within {j.within} ms" if j.within is not None else "") if j.kind != "unnest" else "unnest" for j in node.joins]
        if node.where is not None:
            parts.append("filter")
        if node.latest_by:
            parts.append("latest by")
        if node.window:
            parts.append(f"{node.window.kind} window {node.window.size} ms")
        if node.group_by or node.group_all or any(is_aggregate(i.expr) for i in node.items):
            parts.append("aggregate")
        return " -> ".join([*parts, "project"])

    return show(parse(text))


def is_aggregate(node) -> bool:
    return any(isinstance(x, S.Call) and (x.name in R.AGGREGATES or x.name in R.USER_AGGREGATES) for x in S.walk(node))


def conjuncts(node) -> list:
    if isinstance(node, S.Binary) and node.op == "AND":
        return [*conjuncts(node.left), *conjuncts(node.right)]
    return [] if node is None else [node]


class Builder:
    def __init__(self, session: Session, mode: str, names: list[str]):
        """names: the sources of the whole statement."""
        if mode not in ("table", "pipeline"):
            raise ValueError(mode)
        self.session, self.mode, self.names_read, self.serial = session, mode, names, 0

    # -- queries ------------------------------------------------------------------------------

    def query(self, node) -> Relation:
        return self.union(node) if isinstance(node, S.Union) else self.select(node)

    def union(self, node: S.Union) -> Relation:
        if node.distinct and self.mode == "pipeline":
            raise DialectError("UNION DISTINCT is for tables; use UNION ALL", *node.pos)
        parts = [self.select(b) for b in node.branches]
        first = parts[0]
        for p in parts[1:]:
            if len(p.fields) != len(first.fields):
                raise DialectError("UNION branches differ in their number of columns", *node.pos)
        kinds = []
        for i, (name, _) in enumerate(first.fields):
            kind = R.common_kind([p.fields[i][1] for p in parts])
            if kind is None:
                raise DialectError(f"UNION branches differ in the kind of {name}", *node.pos)
            kinds.append(kind)
        names = [n for n, _ in first.fields]
        plain = node.distinct and self.session.identity == "columns"
        dfs = [p.df.select(*[q(n).cast(V.SPARK[k]).alias(out) for (n, _), k, out in zip(p.fields, kinds, names, strict=True)], *([] if plain else [q(m) for m in META])) for p in parts]
        df = reduce(DataFrame.union, dfs)
        if node.distinct and not plain:
            df = df.distinct()
        elif node.distinct:
            df = df.distinct().withColumns({"_ts": F.lit(0).cast("bigint"), "_source": F.lit(None).cast("string")})
        return Relation(df, list(zip(names, kinds, strict=True)))

    def source(self, node) -> tuple[str, Relation]:
        if isinstance(node, S.Derived):
            return node.alias, Builder(self.session, self.mode, self.names_read).query(node.query)
        if node.name not in self.session.relations:
            raise DialectError(f"unknown source {node.name}", *node.pos)
        rel = self.session.relations[node.name]
        if self.mode == "pipeline" and "_arrival" in rel.df.columns and not rel.df.isStreaming:
            timed = [n for n in self.names_read if n in self.session.relations and "_arrival" in self.session.relations[n].df.columns]
            rel = replace(rel, df=lateness.drop_late_among([self.session.relations[n].df for n in timed], timed.index(node.name), "_ts", "_arrival"))
        return node.alias, rel

    def frame(self, alias: str, rel: Relation) -> Frame:
        columns = [q(n).alias(f"{alias}.{n}") for n, _ in rel.fields if n not in META] + [q(m).alias(f"{alias}.{m}") for m in META]
        scope = {n.lower(): (f"{alias}.{n}", k) for n, k in rel.fields}
        scope |= {"_ts": (f"{alias}._ts", V.LONG), "_source": (f"{alias}._source", V.STRING)}
        order = [q("_arrival").alias("__arrival")] if "_arrival" in rel.df.columns else []
        df = rel.df.select(*columns, q("_ts").alias("__ts"), *order)
        if df.isStreaming:
            if rel.window:
                raise DialectError(f"{alias} is windowed; a stream takes no window over windows")
            df = df.withColumn("__time", F.timestamp_millis("__ts")).withWatermark("__time", f"{lateness.DELAY_MS} milliseconds")
        return Frame(df, {alias: scope}, [(alias, [n for n, _ in rel.fields])])

    def select(self, node: S.Select) -> Relation:
        self.check(node)
        alias, rel = self.source(node.source)
        fr = self.frame(alias, rel)
        for j in node.joins:
            fr = self.join(fr, j)
        fr = self.where(fr, node.where)
        items = self.stars(fr, node.items)
        if node.latest_by:
            fr = self.latest(fr, node)
        grouped = bool(node.group_by or node.group_all or node.window or any(is_aggregate(i.expr) for i in items))
        for i in items:
            fr = self.scalars(fr, i.expr)
        return self.grouped(fr, node, items) if grouped else self.project(fr, items)

    def check(self, node: S.Select) -> None:
        aggregated = bool(node.group_by or node.group_all or any(is_aggregate(i.expr) for i in node.items))
        if self.mode == "table":
            if node.window or node.emit:
                raise DialectError("WINDOW and EMIT are for pipelines", *node.pos)
        elif (aggregated or node.emit) and not node.window:
            raise DialectError("aggregates, GROUP BY and EMIT need a WINDOW in a pipeline", *node.pos)
        if node.latest_by:
            if self.mode == "pipeline":
                raise DialectError("LATEST BY is for tables", *node.pos)
            if aggregated:
                raise DialectError("LATEST BY excludes GROUP BY and aggregates", *node.pos)
        aliases = [node.source.alias, *(j.source.alias for j in node.joins)]
        if len(set(aliases)) < len(aliases):
            raise DialectError("an alias is used twice", *node.pos)

    # -- joins --------------------------------------------------------------------------------

    def join(self, left: Frame, j: S.Join) -> Frame:
        if j.kind == "unnest":
            e = self.expr(left, j.source.expr)
            if e.kind != V.JSON:
                raise DialectError("UNNEST takes a JSON value", *j.source.pos)
            name = f"{j.source.alias}."
            df = left.df.withColumn(name, F.explode(V.json_array(e.col)))
            return Frame(df, {**left.scope, j.source.alias: {"": (name, V.JSON), j.source.alias.lower(): (name, V.JSON)}}, [*left.order, (j.source.alias, [j.source.alias])])
        alias, rel = self.source(j.source)
        right = self.frame(alias, rel)
        right.df = right.df.withColumnsRenamed({"__ts": "__rts", "__time": "__rtime"}).drop("__arrival")
        both = Frame(left.df, {**left.scope, **right.scope}, [*left.order, *right.order])
        if self.mode == "pipeline" and j.within is None:
            raise DialectError("a pipeline's join needs WITHIN", *j.pos)
        if self.mode == "table" and j.within is not None:
            raise DialectError("WITHIN is for pipelines", *j.pos)
        keys, rest = [], []
        for c in conjuncts(j.on):
            sides = self.sides(left, right, c)
            (keys if sides else rest).append(sides or c)
        if j.kind != "cross" and not keys:
            raise DialectError("ON needs an equality between the two sides", *j.pos)
        pairs = [(self.promoted(self.expr(left, a), self.expr(right, b))) for a, b in keys]
        residual = reduce(lambda a, b: a & b, [self.expr(both, c).col for c in rest]) if rest else None
        if j.within is not None and left.df.isStreaming:
            if "__joined" in left.df.columns:
                raise DialectError("a stream takes one join", *j.pos)
            df = J.stream_interval_join(left.df, right.df, pairs, F.col("__time"), F.col("__rtime"), j.within, "inner" if j.kind == "cross" else j.kind, residual).withColumn("__joined", F.lit(True))
        elif j.within is not None:
            df = J.interval_join(left.df, right.df, pairs, F.col("__ts"), F.col("__rts"), j.within, "inner" if j.kind == "cross" else j.kind, residual)
        elif j.kind == "cross":
            df = left.df.crossJoin(right.df)
        else:
            on = reduce(lambda a, b: a & b, [a == b for a, b in pairs])
            df = left.df.join(right.df, on if residual is None else on & residual, j.kind)
        both.df = df.withColumn("__ts", F.greatest("__ts", "__rts")).drop("__rts")
        return both

    def sides(self, left: Frame, right: Frame, c) -> tuple | None:
        """(of left, of right) if c is an equality with one side over each."""
        if not (isinstance(c, S.Binary) and c.op == "="):
            return None
        for a, b in ((c.left, c.right), (c.right, c.left)):
            if self.only(a, left) and self.only(b, right):
                return a, b
        return None

    @staticmethod
    def only(node, fr: Frame) -> bool:
        names = [x for x in S.walk(node) if isinstance(x, S.Name)]
        ok = lambda n: n.alias in fr.scope if n.alias else n.column in fr.scope or any(n.column.lower() in s for s in fr.scope.values())
        return bool(names) and all(ok(n) for n in names) and not any(isinstance(x, (S.ScalarQuery, S.InQuery, S.Exists)) for x in S.walk(node))

    @staticmethod
    def promoted(a: Typed, b: Typed) -> tuple[Column, Column]:
        if a.kind in V.NUMBERS and b.kind in V.NUMBERS and V.DOUBLE in (a.kind, b.kind):
            return a.col.cast("double"), b.col.cast("double")
        if a.kind != b.kind and not {a.kind, b.kind} <= V.NUMBERS:
            return F.lit(None).cast("string"), F.lit(None).cast("string")  # kinds that never compare equal
        return a.col, b.col

    # -- filters and subqueries -----------------------------------------------------------------

    def where(self, fr: Frame, node) -> Frame:
        plain = []
        for c in conjuncts(node):
            if isinstance(c, S.InQuery):
                fr = self.in_query(fr, c)
            elif isinstance(c, S.Exists):
                inner = self.select(c.query)
                fr = replace(fr, df=J.exists(fr.df, inner.df, c.negated))
            else:
                for x in S.walk(c):
                    if isinstance(x, (S.InQuery, S.Exists)):
                        raise DialectError("IN and EXISTS subqueries stand alone between ANDs", *x.pos)
                fr = self.scalars(fr, c)
                plain.append(c)
        for c in plain:
            e = self.expr(fr, c)
            if e.kind not in (V.BOOL, V.NULL):
                raise DialectError("WHERE takes a condition", *node.pos)
            fr = replace(fr, df=fr.df.filter(e.col.cast("boolean")))
        return fr

    def in_query(self, fr: Frame, c: S.InQuery) -> Frame:
        if fr.df.isStreaming:
            raise DialectError("a stream takes no subqueries", *c.pos)
        inner = self.select(c.query)
        names = [n for n, _ in inner.fields if n not in ("window_start", "window_end")]
        if len(names) != 1:
            raise DialectError("IN takes a subquery of one column", *c.pos)
        x = self.expr(fr, c.arg)
        member = Typed(q(names[0]), dict(inner.fields)[names[0]])
        value, wanted = self.promoted(x, member)
        if self.mode == "pipeline":
            if inner.window is None or inner.window.kind != "tumbling" or c.negated:
                raise DialectError("a pipeline's IN takes a subquery with a tumbling window, without NOT", *c.pos)
            found = inner.df.select(F.col("_ts").alias("__end"), wanted.alias("__member"))
            return replace(fr, df=J.snapshot_semi(fr.df, "__ts", value, found, "__end", "__member", inner.window.size))
        sub = inner.df.select(wanted.alias("__member"))
        return replace(fr, df=J.anti(fr.df, value, sub) if c.negated else J.semi(fr.df, value, sub))

    def scalars(self, fr: Frame, node) -> Frame:
        """Joins the values of the scalar subqueries in node."""
        for x in S.walk(node):
            if isinstance(x, S.ScalarQuery) and x not in fr.extra:
                fr = self.scalar(fr, x)
        return fr

    def scalar(self, fr: Frame, x: S.ScalarQuery) -> Frame:
        sub: S.Select = x.query
        if fr.df.isStreaming:
            raise DialectError("a stream takes no subqueries", *x.pos)
        if len(sub.items) != 1 or not is_aggregate(sub.items[0].expr):
            raise DialectError("a scalar subquery is one aggregate", *x.pos)
        if sub.group_by or sub.group_all:
            raise DialectError("a scalar subquery has no GROUP BY of its own", *x.pos)
        own = {sub.source.alias, *(j.source.alias for j in sub.joins)}
        inner_keys, outer_keys, rest = [], [], []
        for c in conjuncts(sub.where):
            pair = None
            if isinstance(c, S.Binary) and c.op == "=":
                for a, b in ((c.left, c.right), (c.right, c.left)):
                    if isinstance(a, S.Name) and a.alias in fr.scope and a.alias not in own and not (isinstance(b, S.Name) and b.alias in fr.scope and b.alias not in own):
                        pair = (a, b)
            if pair:
                outer_keys.append(pair[0])
                inner_keys.append(pair[1])
            else:
                rest.append(c)
        self.serial += 1
        name, keys = f"__scalar{self.serial}", [f"__key{self.serial}_{i}" for i in range(len(inner_keys))]
        where = reduce(lambda a, b: S.Binary("AND", a, b), rest) if rest else None
        sub = replace(sub, where=where, items=(S.Item(sub.items[0].expr, name), *(S.Item(e, k) for e, k in zip(inner_keys, keys, strict=True))), group_by=(*sub.group_by, *inner_keys))
        inner = self.select(sub)
        kind = dict(inner.fields)[name]
        if self.mode == "pipeline":
            if outer_keys or inner.window is None or inner.window.kind != "tumbling":
                raise DialectError("a pipeline's scalar subquery is uncorrelated and has a tumbling window", *x.pos)
            df = J.snapshot_scalar(fr.df, "__ts", inner.df.select(F.col("_ts").alias("__end"), q(name).alias("__value")), "__end", "__value", inner.window.size, name)
        elif outer_keys:
            on = [self.promoted(self.expr(fr, o), Typed(q(k), dict(inner.fields)[k])) for o, k in zip(outer_keys, keys, strict=True)]
            df = fr.df.join(inner.df.select(name, *keys), reduce(lambda a, b: a & b, [a == b for a, b in on]), "left" if self.session.scalar_null_pad else "inner").drop(*keys)
        else:
            df = fr.df.join(F.broadcast(inner.df.select(name)))  # at most one row
        return replace(fr, df=df, extra={**fr.extra, x: (name, kind)})

    # -- output -------------------------------------------------------------------------------

    def stars(self, fr: Frame, items: tuple[S.Item, ...]) -> list[S.Item]:
        out = []
        for i in items:
            if not isinstance(i.expr, S.Star):
                out.append(i)
                continue
            if i.expr.alias is not None and i.expr.alias not in fr.scope:
                raise DialectError(f"unknown alias {i.expr.alias}", *i.expr.pos)
            for alias, names in fr.order:
                if i.expr.alias in (None, alias):
                    out += [S.Item(S.Name(alias, n), f"{alias}_{n}" if len(fr.order) > 1 else n) for n in names]
        return out

    @staticmethod
    def names(items: list[S.Item]) -> list[str]:
        out = []
        for n, i in enumerate(items, 1):
            match i:
                case S.Item(alias=str(a)):
                    out.append(a)
                case S.Item(expr=S.Name(column=c)):
                    out.append(c)
                case S.Item(expr=S.Call(name="COUNT", args=(S.Star(),))):
                    out.append("count_star")
                case S.Item(expr=S.Call(name=f)):
                    out.append(f.lower())
                case S.Item(expr=S.Access(key=str(k))):
                    out.append(k)
                case _:
                    out.append(f"col{n}")
        if len({x.lower() for x in out}) < len(out):
            raise DialectError(f"two output columns share a name: {sorted(x for x in out if out.count(x) > 1)}")
        return out

    def project(self, fr: Frame, items: list[S.Item]) -> Relation:
        names, typed = self.names(items), [self.expr(fr, i.expr) for i in items]
        first = fr.order[0][0]
        df = fr.df.select(*[t.col.cast(V.SPARK[t.kind]).alias(n) for n, t in zip(names, typed, strict=True) if n not in META], F.col("__ts").alias("_ts"), q(f"{first}._source").alias("_source"))
        return Relation(df, [(n, t.kind) for n, t in zip(names, typed, strict=True)])

    def latest(self, fr: Frame, node: S.Select) -> Frame:
        keys = [self.expr(fr, k) for k in node.latest_by]
        held = fr.df.withColumns({f"__latest{i}": k.col for i, k in enumerate(keys)})
        if held.isStreaming:
            from tidewell.streaming import drivers

            return replace(fr, df=drivers.latest_by(held.drop("__time"), [f"__latest{i}" for i in range(len(keys))], "__ts"))
        out = latest.latest_by(held, [f"__latest{i}" for i in range(len(keys))], "__ts", "__arrival" if "__arrival" in held.columns else None)
        return replace(fr, df=out.drop(*[f"__latest{i}" for i in range(len(keys))]))

    def grouped(self, fr: Frame, node: S.Select, items: list[S.Item]) -> Relation:
        exprs = list(node.group_by) if not node.group_all else [i.expr for i in items if not is_aggregate(i.expr)]
        keys = {e: self.expr(fr, e) for e in exprs}
        cols = {e: f"__g{i}" for i, e in enumerate(keys)}
        df = fr.df.withColumns({cols[e]: t.col.cast(V.SPARK[t.kind]) for e, t in keys.items()}) if keys else fr.df
        bounds = []
        if df.isStreaming:
            if node.emit == "CHANGES" or "__joined" in df.columns or not node.window:
                raise DialectError("a stream takes windows over one source, without EMIT CHANGES (see drivers.emit_changes)", *node.pos)
            df = windows.stream_window(df, "__time", node.window.kind, node.window.size, node.window.advance)
            bounds = ["__window"]
        elif node.window:
            df = windows.assign(df, "__ts", node.window.kind, node.window.size, node.window.advance, list(cols.values()))
            bounds = ["window_start", "window_end"]
        aggs: dict[object, tuple[str, str]] = {}
        for i in items:
            for x in S.walk(i.expr):
                if isinstance(x, S.Call) and (x.name in R.AGGREGATES or x.name in R.USER_AGGREGATES) and x not in aggs:
                    if any(is_aggregate(a) for a in x.args):
                        raise DialectError("aggregates don't nest", *x.pos)
                    aggs[x] = (f"__a{len(aggs)}", "")
        calls = []
        for x, (name, _) in aggs.items():
            stars = [a for a in x.args if isinstance(a, S.Star)]
            if stars and (x.name != "COUNT" or len(x.args) > 1):
                raise DialectError(f"* stands in COUNT only, not in {x.name}", *x.pos)
            wanted = 2 if x.name == "PERCENTILE_CONT" else 1
            if len(x.args) != wanted:
                raise DialectError(f"{x.name} takes {wanted} argument{'s' * (wanted > 1)}", *x.pos)
            args = () if stars else tuple(self.expr(fr, a) for a in x.args)
            if x.name == "PERCENTILE_CONT" and not (isinstance(x.args[0], S.Literal) and isinstance(x.args[0].value, (int, float)) and 0 <= x.args[0].value <= 1):
                raise DialectError("PERCENTILE_CONT takes a literal share from 0 to 1", *x.pos)
            t = R.aggregate(x.name, args, x.distinct)
            aggs[x] = (name, t.kind)
            calls.append((t.col, name))
        group = [*cols.values(), *bounds]
        counted = [*(c.alias(n) for c, n in calls), F.count(F.lit(1)).alias("__rows")]
        if df.isStreaming:
            counted += [F.min("__ts").alias("__first"), F.max("__ts").alias("__last")]
        rows = df
        # Without keys there is one group, which only exists once it has a row.
        df = df.groupBy(*group).agg(*counted) if group else df.agg(*counted).filter("__rows > 0")
        if df.isStreaming:
            df, bounds = windows.stream_bounds(df, node.window.kind), ["window_start", "window_end"]
        changes = node.emit == "CHANGES"
        if changes:  # one row per event with what the window held by then, then the final one
            if any(x.distinct or x.name in ("MEDIAN", "PERCENTILE_CONT") for x in aggs):
                raise DialectError("EMIT CHANGES takes aggregates that run: no DISTINCT, MEDIAN or PERCENTILE_CONT", *node.pos)
            so_far = W.partitionBy(*group).orderBy("__arrival" if "__arrival" in rows.columns else "__ts").rowsBetween(W.unboundedPreceding, 0)
            steps = rows.select(*group, *[c.over(so_far).alias(n) for c, n in calls], F.lit(1).cast("bigint").alias("__rows"), F.lit(False).alias("_final"))
            df = steps.unionByName(df.withColumn("_final", F.lit(True)))
        after = Frame(df, extra={**{e: (c, keys[e].kind) for e, c in cols.items()}, **aggs, **fr.extra})
        names = self.names(items)
        for n, i in zip(names, items, strict=True):
            if n.lower() in {*bounds, *META, *(["_final"] if changes else [])}:
                raise DialectError(f"{n} is a column of the window's own; take another name", *getattr(i.expr, "pos", node.pos))
        out, fields = [], []
        for n, i in zip(names, items, strict=True):
            t = self.expr(after, i.expr)
            out.append(t.col.cast(V.SPARK[t.kind]).alias(n))
            fields.append((n, t.kind))
        fields += [(b, V.LONG) for b in bounds]
        if changes:
            fields.append(("_final", V.BOOL))
            bounds = [*bounds, "_final"]
        time = F.col("window_end") if node.window else F.lit(0).cast("bigint")
        df = df.select(*out, *bounds, time.alias("_ts"), F.lit(None).cast("string").alias("_source"))
        return Relation(df, fields, node.window, True)

    # -- expressions ----------------------------------------------------------------------------

    def expr(self, fr: Frame, node) -> Typed:
        if node in fr.extra:
            name, kind = fr.extra[node]
            return Typed(q(name), kind)
        match node:
            case S.Literal(value=v):
                kind = V.NULL if v is None else V.BOOL if isinstance(v, bool) else V.LONG if isinstance(v, int) else V.DOUBLE if isinstance(v, float) else V.STRING
                return Typed(F.lit(v).cast(V.SPARK[kind]), kind)
            case S.Name():
                if not fr.scope:
                    raise DialectError(f"{node.column} is neither grouped nor aggregated", *node.pos)
                name, kind = fr.find(node)
                return Typed(q(name), kind)
            case S.Access():
                return self.access(fr, node)
            case S.Unary(op="NOT"):
                return Typed(~self.condition(fr, node.arg), V.BOOL)
            case S.Unary():
                x = R.number(self.expr(fr, node.arg))
                if x.kind not in V.NUMBERS:
                    return Typed(F.lit(None).cast("double"), V.DOUBLE)
                return Typed(-x.col if x.kind == V.DOUBLE else F.try_subtract(F.lit(0).cast("bigint"), x.col), x.kind)
            case S.Binary(op="AND"):
                return Typed(self.condition(fr, node.left) & self.condition(fr, node.right), V.BOOL)
            case S.Binary(op="OR"):
                return Typed(self.condition(fr, node.left) | self.condition(fr, node.right), V.BOOL)
            case S.Binary():
                a, b = self.expr(fr, node.left), self.expr(fr, node.right)
                for x, other in ((a, b), (b, a)):
                    if x.kind == V.JSON and not (node.op == "=" and other.kind == V.NULL):
                        raise DialectError("a JSON value doesn't compare or compute; take ->> or a conversion", *node.pos)
                return self.compare(node.op, a, b) if node.op in ("=", "!=", "<", "<=", ">", ">=") else self.arithmetic(node.op, a, b)
            case S.Call():
                return self.call(fr, node)
            case S.Star():
                raise DialectError("* stands alone", *node.pos)
        raise DialectError("a subquery can't stand here", *getattr(node, "pos", (0, 0)))

    def condition(self, fr: Frame, node) -> Column:
        e = self.expr(fr, node)
        if e.kind not in (V.BOOL, V.NULL):
            raise DialectError("expected a condition", *getattr(node, "pos", (0, 0)))
        return e.col.cast("boolean")

    def access(self, fr: Frame, node: S.Access) -> Typed:
        base = self.expr(fr, node.base)
        if base.kind != V.JSON:
            raise DialectError("-> and ->> take a JSON value", *node.pos)
        root, steps = (base.base, base.steps) if base.base is not None else (base.col, ())
        steps = (*steps, node.key)
        if node.text:
            return Typed(V.json_text(root, steps), V.STRING)
        return Typed(V.json_get(root, steps), V.JSON, root, steps)

    @staticmethod
    def compare(op: str, a: Typed, b: Typed) -> Typed:
        both = {a.kind, b.kind}
        if V.NULL in both:
            return Typed(F.lit(None).cast("boolean"), V.BOOL)
        if a.kind != b.kind and not both <= V.NUMBERS:
            known = a.col.isNotNull() & b.col.isNotNull()
            value = {"=": F.lit(False), "!=": F.lit(True)}.get(op, F.lit(None).cast("boolean"))
            return Typed(F.when(known, value), V.BOOL)
        x, y = (a.col.cast("double"), b.col.cast("double")) if V.DOUBLE in both else (a.col, b.col)
        out = {"=": lambda: x == y, "!=": lambda: x != y, "<": lambda: x < y, "<=": lambda: x <= y, ">": lambda: x > y, ">=": lambda: x >= y}[op]()
        return Typed(out, V.BOOL)

    @staticmethod
    def arithmetic(op: str, a: Typed, b: Typed) -> Typed:
        if not {a.kind, b.kind} <= V.NUMBERS | {V.NULL} or V.NULL in (a.kind, b.kind):
            return Typed(F.lit(None).cast("double"), V.DOUBLE)
        if op == "/":
            return Typed(F.try_divide(a.col.cast("double"), b.col.cast("double")), V.DOUBLE)
        whole = V.DOUBLE not in (a.kind, b.kind)
        x, y = (a.col, b.col) if whole else (a.col.cast("double"), b.col.cast("double"))
        if op == "%":
            return Typed(F.try_mod(x, y), V.LONG if whole else V.DOUBLE)
        if not whole:
            return Typed({"+": x + y, "-": x - y, "*": x * y}[op], V.DOUBLE)
        return Typed({"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op](x, y), V.LONG)

    def call(self, fr: Frame, node: S.Call) -> Typed:
        if node.name in R.AGGREGATES or node.name in R.USER_AGGREGATES:
            raise DialectError(f"{node.name} can't stand here", *node.pos)
        f = R.BUILT_IN.get(node.name) or R.REGISTERED.get(node.name)
        if f is None:
            raise DialectError(f"unknown function {node.name}", *node.pos)
        if len(node.args) < f.least or f.most is not None and len(node.args) > f.most:
            raise DialectError(f"{node.name} takes {f.least}" + ("" if f.most == f.least else f" to {f.most}" if f.most else " or more") + " arguments", *node.pos)
        return f.build([self.expr(fr, a) for a in node.args])
