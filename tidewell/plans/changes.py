"""Table statements as changelogs: what a statement's result retracts and asserts from epoch to epoch.

A change source is a log of weighted rows by epoch. The state after an epoch is the log netted up to it; a statement's
deltas are the difference of its results over two such states. Where every result row depends on rows of one key
(GROUP BY or LATEST BY of plain columns of one source), only the keys that the epoch's changes touch are computed.
Retention evicts rows of the result, so an eviction is a retraction like any other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.operators import latest, zset
from tidewell.plans.builder import Builder, Relation, Session, is_aggregate, q, references
from tidewell.sql import tree as S
from tidewell.sql.parser import parse
from tidewell.sql.tree import DialectError

EPOCH = "_epoch"


def supports_retention(text: str) -> bool:
    """Only a statement over one plain source without joins, groups, aggregates and unions has rows that can age out one by one."""
    node = parse(text)
    return isinstance(node, S.Select) and isinstance(node.source, S.Source) and not (node.joins or node.group_by or node.group_all or any(is_aggregate(i.expr) for i in node.items))


def retained(rel: Relation, text: str, max_rows: int | None = None, ttl_ms: int | None = None) -> DataFrame:
    """The statement's rows that a retention policy keeps: the newest max_rows of them (ties by all columns), or those within ttl_ms of the newest."""
    if not supports_retention(text):
        raise DialectError("retention takes a statement over one source without joins, groups, aggregates and unions")
    names = [n for n, _ in rel.fields]
    df = rel.df
    if ttl_ms is not None:
        df = latest.retain_ttl(df, ttl_ms, "_ts")
    if max_rows is not None:
        df = df.orderBy(F.desc("_ts"), *[q(n).desc() for n in names]).limit(max_rows)
    return df


class Changelog:
    """Change sources by name beside a session's other relations."""

    def __init__(self, session: Session):
        self.session = session
        self.logs: dict[str, tuple[DataFrame, dict]] = {}

    def register(self, name: str, log: DataFrame, **options) -> Changelog:
        """log has _weight and _epoch beside the source's columns; options are those of Session.register."""
        self.logs[name] = (log, options)
        return self

    def _at(self, epoch: int, keys: dict[str, DataFrame]) -> Session:
        """A session with every log netted up to epoch, of the named sources the rows with these keys."""
        out = Session(self.session.spark, self.session.scalar_null_pad, self.session.identity)
        out.relations = dict(self.session.relations)
        for name, (log, options) in self.logs.items():
            columns = [c for c in log.columns if c not in (EPOCH, zset.WEIGHT)]
            log = log.filter(F.col(EPOCH) <= epoch)
            if name in keys:
                touched = keys[name].toDF(*[f"__k{i}" for i in range(len(keys[name].columns))])
                same = reduce(lambda a, b: a & b, [q(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(keys[name].columns)])
                log = log.join(touched, same, "left_semi")
            net = zset.consolidate(log, columns).filter(f"{zset.WEIGHT} > 0")
            out.register(name, net.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col(zset.WEIGHT).cast("int")))).select(*[q(c) for c in columns]), **options)
        return out

    def _keys(self, text: str) -> tuple[str, list[str]] | None:
        """(change source, its columns) that a result row's dependence goes by, or None."""
        node = parse(text)
        if not isinstance(node, S.Select) or not isinstance(node.source, S.Source) or node.joins or node.source.name not in self.logs:
            return None
        by = node.latest_by or node.group_by or [i.expr for i in node.items if node.group_all and not is_aggregate(i.expr)]
        columns = {c.lower(): c for c in self.logs[node.source.name][0].columns}
        if not by or not all(isinstance(e, S.Name) and e.column.lower() in columns for e in by) or len(references(text)) > 1:
            return None
        return node.source.name, [columns[e.column.lower()] for e in by]

    def deltas(self, text: str, epochs: list[int], max_rows: int | None = None, ttl_ms: int | None = None) -> DataFrame:
        """The statement's columns, _weight and _epoch: what each of the epochs, in order, changes since the one before it in the list."""
        names = [n for n, _ in Builder(self._at(epochs[0], {}), "table", references(text)).query(parse(text)).fields]
        by = self._keys(text)
        parts, before = [], None
        for epoch in epochs:
            keys = {}
            if by and max_rows is None and ttl_ms is None:
                log = self.logs[by[0]][0].filter(F.col(EPOCH) <= epoch)
                keys[by[0]] = (log if before is None else log.filter(F.col(EPOCH) > before)).select(*[q(c) for c in by[1]]).distinct()

            def result(at: int, keys: dict = keys) -> DataFrame:
                rel = self._at(at, keys).compile(text)
                df = rel.df if max_rows is None and ttl_ms is None else retained(rel, text, max_rows, ttl_ms)
                return df.select(*[q(n) for n in names])

            after = result(epoch)
            old = result(before) if before is not None else after.limit(0)
            parts.append(zset.difference(after, old, [f"`{n}`" for n in names]).withColumn(EPOCH, F.lit(epoch).cast("long")))
            before = epoch
        return reduce(DataFrame.unionByName, parts)
