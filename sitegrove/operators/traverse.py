"""Traversal and fixpoints: frontier loops over an edge table, each round one shuffle join, lineage cut in the shared folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from sitegrove.operators.query import Query, find_relations, predicate
from sitegrove.session import cut

#: Rounds after which the visited set is written as one table again.
COMPACT_EVERY = 8


def reachable(edges: DataFrame, starts: DataFrame, max_rounds: int | None = None, stop: DataFrame | None = None) -> DataFrame:
    """(start, id, depth) of all nodes that the edges (from_id, to_id) lead to from each start, the starts at depth 0.

    Cycles end as visited nodes are left out of the next frontier; depth is the least number of edges. Nodes in `stop`
    (id) are neither entered nor counted. Null ends lead nowhere.
    """
    links = cut(edges.select("from_id", "to_id").where(F.col("from_id").isNotNull() & F.col("to_id").isNotNull()).distinct())
    frontier = cut(starts.select(F.col("id").alias("start"), F.col("id")).where(F.col("id").isNotNull()).distinct().withColumn("depth", F.lit(0)))
    visited, rounds = frontier, 0
    while (max_rounds is None or rounds < max_rounds) and not frontier.isEmpty():
        rounds += 1
        step = frontier.select("start", F.col("id").alias("from_id")).join(links, "from_id").select("start", F.col("to_id").alias("id")).distinct()
        if stop is not None:
            step = step.join(stop.select("id"), "id", "left_anti")
        frontier = cut(step.join(visited.select("start", "id"), ["start", "id"], "left_anti").select("start", "id", F.lit(rounds).alias("depth")))
        visited = visited.unionByName(frontier)
        if rounds % COMPACT_EVERY == 0:
            visited = cut(visited)
    return visited


def reached_set(edges: DataFrame, starts: DataFrame, **limits) -> DataFrame:
    """(id, depth) of the nodes that any start leads to: the same loop with one common start."""
    links = cut(edges.select("from_id", "to_id").where(F.col("from_id").isNotNull() & F.col("to_id").isNotNull()).distinct())
    frontier = cut(starts.select("id").where(F.col("id").isNotNull()).distinct().withColumn("depth", F.lit(0)))
    visited, rounds, most, stop = frontier, 0, limits.get("max_rounds"), limits.get("stop")
    while (most is None or rounds < most) and not frontier.isEmpty():
        rounds += 1
        step = links.join(frontier.select(F.col("id").alias("from_id")), "from_id", "left_semi").select(F.col("to_id").alias("id")).distinct()
        if stop is not None:
            step = step.join(stop.select("id"), "id", "left_anti")
        frontier = cut(step.join(visited.select("id"), "id", "left_anti").withColumn("depth", F.lit(rounds)))
        visited = visited.unionByName(frontier)
        if rounds % COMPACT_EVERY == 0:
            visited = cut(visited)
    return visited


#: Most ids in a row that a walk gives, before it is exploded.
IDS = 8192
#: Kinds of rows that a walk gets: edges and targets in every part, the others in their start's.
EDGE, TARGET, WITHOUT, START = range(4)


def _dealt(edges: DataFrame, starts: DataFrame, targets: DataFrame | None = None, without: DataFrame | None = None) -> DataFrame:
    """(part, kind, a, b, n): starts (id, label) dealt to one part per core by their hash, all edges (from_id, to_id, n) with each."""
    parts = edges.sparkSession.sparkContext.defaultParallelism

    def rows(df: DataFrame, kind: int, a: str, b: str | None = None, n: str | None = None) -> DataFrame:
        part = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))) if kind in (EDGE, TARGET) else F.pmod(F.xxhash64(a), F.lit(parts)).cast("int")
        columns = [F.lit(kind).alias("kind"), F.col(a).alias("a"), (F.col(b) if b else F.lit(None).cast("string")).alias("b"), (F.col(n) if n else F.lit(0)).alias("n")]
        return df.where(F.col(a).isNotNull()).select(part.alias("part"), *columns)

    out = rows(edges.where(F.col("to_id").isNotNull()), EDGE, "from_id", "to_id", "n").unionByName(rows(starts, START, "id", "label"))
    if targets is not None:
        out = out.unionByName(rows(targets, TARGET, "id"))
    if without is not None:
        out = out.unionByName(rows(without, WITHOUT, "start", "id"))
    return out.repartitionById(parts, F.col("part"))


class _Part:
    """A part's graph with its nodes numbered: `to[first[x]:first[x + 1]]` are the targets of x in order."""

    def __init__(self, batches: list[pa.RecordBatch]) -> None:
        rows = pa.Table.from_batches(batches)
        kinds = [rows.filter(pc.equal(rows["kind"], kind)) for kind in range(4)]
        columns = [kinds[EDGE]["a"], kinds[EDGE]["b"], kinds[TARGET]["a"], kinds[WITHOUT]["a"], kinds[WITHOUT]["b"], kinds[START]["a"]]
        rank, self.labels = kinds[EDGE]["n"].to_numpy(), kinds[START]["b"].to_pylist()
        del rows, kinds
        coded = pa.chunked_array([c for column in columns for c in column.chunks], pa.string()).cast(pa.large_string()).combine_chunks().dictionary_encode()
        self.names = coded.dictionary.cast(pa.string())
        sources, self.to, self.targets, of, listed, self.starts = np.split(coded.indices.to_numpy(), np.cumsum([len(c) for c in columns])[:-1])
        self.n = len(self.names)
        order = np.lexsort((rank, sources))
        self.to, self.first = self.to[order], np.concatenate(([0], np.cumsum(np.bincount(sources, minlength=self.n))))
        self.without: dict[int, list[int]] = {}
        for start, id_ in zip(of.tolist(), listed.tolist(), strict=True):
            self.without.setdefault(start, []).append(id_)

    def keep(self, order: np.ndarray) -> None:
        """Renumbers the nodes by their place in `order`; those that aren't in it, and their edges, go."""
        number = np.full(self.n, -1, dtype=np.int64)
        number[order] = np.arange(order.size)
        n = np.diff(self.first)[order]
        ends = np.cumsum(n)
        self.to = number[self.to[np.repeat(self.first[:-1][order] - ends + n, n) + np.arange(n.sum())]]
        self.first, self.starts, self.n = np.concatenate(([0], ends)), number[self.starts], order.size
        self.names = self.names.take(pa.array(order))

    def levels(self, start: int, seen: np.ndarray, mark: np.ndarray, stamp: int) -> Iterator[np.ndarray]:
        """The nodes by their distance from `start`; visited ones have `stamp` in `seen`."""
        front = np.array([start])
        while front.size:
            seen[front] = stamp
            yield front
            low = self.first[front]
            n = self.first[front + 1] - low
            ends = np.cumsum(n)
            found = self.to[np.repeat(low - ends + n, n) + np.arange(ends[-1])]
            found = found[seen[found] != stamp]
            at = np.arange(found.size)
            mark[found] = at
            front = found[mark[found] == at]


WALKED = StructType().add("start", StringType()).add("label", StringType()).add("n", IntegerType()).add("ids", ArrayType(StringType()))


def _sent(part: _Part, walks: Iterator[tuple[int, str | None, int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Batches of (start, label, n, ids) in rows of at most IDS ids, and about as many ids in each batch as in eight rows.

    `n` is the number given, plus the ids of the row's walk before it where that is told by a negative one: ~n.
    """
    rows: list[tuple[int, str | None, int, np.ndarray]] = []
    held = 0

    def batch() -> pa.RecordBatch:
        offsets = np.concatenate(([0], np.cumsum([len(r[3]) for r in rows]))).astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(offsets), part.names.take(pa.array(np.concatenate([r[3] for r in rows]))))
        columns = [part.names.take(pa.array([r[0] for r in rows], pa.int32())), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int32()), ids]
        return pa.RecordBatch.from_arrays(columns, names=["start", "label", "n", "ids"])

    for start, label, n, ids in walks:
        for at in range(0, len(ids), IDS):
            rows.append((start, label, n if n >= 0 else ~n + at, ids[at : at + IDS]))
            held += len(rows[-1][3])
            if held >= 8 * IDS or len(rows) >= IDS:
                yield batch()
                rows, held = [], 0
    if rows:
        yield batch()


def _spread_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    if not (held := list(batches)):
        return
    part = _Part(held)
    del held
    wanted = np.zeros(part.n, dtype=bool)
    wanted[part.targets] = True
    seen, mark = np.full(part.n, -1, dtype=np.int64), np.zeros(part.n, dtype=np.int64)

    def walks() -> Iterator[tuple[int, str | None, int, np.ndarray]]:
        for stamp, (start, label) in enumerate(zip(part.starts.tolist(), part.labels, strict=True)):
            left_out = [x for x in (start, *part.without.get(start, ())) if wanted[x]]
            wanted[left_out] = False
            for depth, level in enumerate(part.levels(start, seen, mark, stamp)):
                yield start, label, depth, level[wanted[level]]
            wanted[left_out] = True

    yield from _sent(part, walks())


def reached_targets(edges: DataFrame, starts: DataFrame, targets: DataFrame, without: DataFrame) -> DataFrame:
    """(start, label, id, depth) of the `targets` (id) that edges (from_id, to_id) lead to from each of `starts` (id, label).

    The start itself and the pairs of `without` (start, id) are left out; labels are passed on. Every task holds all edges, as
    numbers, and walks its starts one by one: there are as many rows as starts and targets multiply to, so only they are
    written, never shuffled or joined.
    """
    dealt = _dealt(edges.select("from_id", "to_id", F.lit(0).alias("n")), starts, targets, without)
    return dealt.mapInArrow(_spread_out, WALKED).select("start", "label", F.explode("ids").alias("id"), F.col("n").alias("depth"))


def _walked(part: _Part, post: bool) -> Iterator[tuple[int, str | None, int, np.ndarray]]:
    """(start, None, ~0, nodes) of each start: its nodes in depth-first order.

    Nodes are first put in the order in which one walk through all starts leaves them, so that what is walked together lies
    together in memory; the names go with them.
    """

    def children() -> list[tuple[int, ...]]:
        to, ends = part.to.tolist(), part.first.tolist()
        return [tuple(to[low:high]) for low, high in zip(ends, ends[1:])]

    def walk(start: int, after: bool) -> list[int]:
        """The nodes not in `seen` that `start` leads to; children without children aren't stacked."""
        met, under = seen, below
        met[start] = 1
        out, nodes, iterators = [] if after else [start], [], []
        add, node, rest = out.append, start, iter(under[start])
        while True:
            for child in rest:
                if not met[child]:
                    met[child] = 1
                    if not after:
                        add(child)
                    if under[child]:
                        nodes.append(node)
                        iterators.append(rest)
                        node, rest = child, iter(under[child])
                        break
                    if after:
                        add(child)
            else:
                if after:
                    add(node)
                if not nodes:
                    return out
                node, rest = nodes.pop(), iterators.pop()

    below, seen = children(), bytearray(part.n)
    order = [x for start in part.starts.tolist() if not seen[start] for x in walk(start, True)]
    below, seen = None, None
    part.keep(np.array(order, dtype=np.int64))
    below, seen = children(), bytearray(part.n)
    for start in part.starts.tolist():
        out = walk(start, post)
        if len(out) > part.n // 8:
            seen = bytearray(part.n)
        else:
            for x in out:
                seen[x] = 0
        yield start, None, ~0, np.array(out, dtype=np.int32)


def _ordered(post: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if held := list(batches):
            part = _Part(held)
            del held
            yield from _sent(part, _walked(part, post))

    return walk


def collect_assets(relations: DataFrame, assets: DataFrame, starts: DataFrame, follow: Query = None, post: bool = False) -> DataFrame:
    """(start, id, visit_seq) in depth-first order, children in edge order, each asset once per start.

    The order depends on every step before, so each start is walked in one task, which holds all edges as numbers; there are as
    many rows as starts and assets multiply to, so they are only written. Use reachable() for sets of more edges than that.
    """
    place = F.row_number().over(Window.partitionBy("from_id").orderBy(F.asc_nulls_last("ord"), F.asc_nulls_last("edge")))
    edges = find_relations(relations, assets, follow).select("from_id", "to_id", "ord", F.col("id").alias("edge")).where(F.col("from_id").isNotNull() & F.col("to_id").isNotNull())
    dealt = _dealt(edges.select("from_id", "to_id", place.alias("n")), starts.select("id").distinct().withColumn("label", F.lit(None).cast("string")))
    return dealt.mapInArrow(_ordered(post), WALKED).select("start", F.posexplode("ids").alias("_at", "id"), "n").select("start", "id", (F.col("n") + F.col("_at")).alias("visit_seq"))


def populate(web: DataFrame, starts: DataFrame, extract: Callable[[DataFrame], DataFrame], follow: Query = None, stop: Query = None, max_rounds: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(assets, relations, diagnostics) of a crawl over `web`, the table of all responses (id, url, type, text ...).

    Each round loads the frontier's urls from `web`, extracts its relations and follows those that match `follow` to
    assets that don't match `stop`. Urls that `web` doesn't hold become unloaded assets without an id of the web, and a
    warning, or only an info if nothing but source map comments lead there. Targets exist even where they aren't followed.
    Without starts the tables are empty.
    """
    frontier = cut(starts.select("url").distinct())
    seen, loaded = frontier, web.where(F.lit(False))
    relations = extract(loaded)
    rounds = 0
    while not frontier.isEmpty() and (max_rounds is None or rounds < max_rounds):
        rounds += 1
        pages = cut(web.join(frontier, "url", "left_semi"))
        found = cut(extract(pages))
        loaded, relations = (pages, found) if rounds == 1 else (loaded.unionByName(pages), relations.unionByName(found))
        followed = found.where(predicate(found, follow) & F.col("url").isNotNull()).select("url").distinct()
        if stop is not None:
            targets = web.join(followed, "url", "left_semi")
            followed = followed.join(targets.where(predicate(targets, stop)).select("url"), "url", "left_anti")
        frontier = cut(followed.join(seen, "url", "left_anti"))
        seen = seen.unionByName(frontier)
        if rounds % COMPACT_EVERY == 0:
            seen, loaded, relations = cut(seen), cut(loaded), cut(relations)
    comment = F.col("type").isin("JavaScriptSourceMappingUrl", "CssSourceMappingUrl", "JavaScriptSourceUrl", "CssSourceUrl")
    led = relations.where(F.col("url").isNotNull()).groupBy("url").agg(F.bool_and(comment).alias("only_comments"))
    missing = seen.join(loaded.select("url"), "url", "left_anti").join(led, "url", "left")
    diagnostics = missing.select(F.when(F.col("only_comments"), "info").otherwise("warn").alias("severity"), F.lit("load").alias("code"), F.lit(None).cast("string").alias("asset_id"), F.concat(F.lit("cannot load "), F.col("url")).alias("message"))
    return loaded, relations, diagnostics


def unreferenced(assets: DataFrame, relations: DataFrame, query: Query = None) -> DataFrame:
    """The ids that go when non-inline matching assets without incoming relations are removed until none is left.

    This counts references, so cycles stay, and start pages go unless the query leaves them out.
    """
    links = cut(relations.select("from_id", "to_id").where(F.col("to_id").isNotNull()).distinct())
    candidates = cut(assets.where(predicate(assets, query) & F.col("url").isNotNull()).select("id").distinct())
    gone = None
    while True:
        now = cut(candidates.join(links.select(F.col("to_id").alias("id")), "id", "left_anti"))
        if now.isEmpty():
            break
        gone = now if gone is None else gone.unionByName(now)
        candidates = cut(candidates.join(now, "id", "left_anti"))
        links = cut(links.join(now.select(F.col("id").alias("from_id")), "from_id", "left_anti"))
    return gone if gone is not None else candidates.limit(0)


def inline_owner(assets: DataFrame, relations: DataFrame) -> DataFrame:
    """(id, owner_id): the nearest asset with a url that holds each asset inline, at any depth; itself for assets with a url."""
    parents = relations.where(F.col("to_id").isNotNull()).join(assets.where(F.col("url").isNull()).select(F.col("id").alias("to_id")), "to_id", "left_semi").groupBy("to_id").agg(F.min_by("from_id", F.struct("ord", "from_id")).alias("parent"))
    owned = assets.where(F.col("url").isNotNull()).select("id", F.col("id").alias("owner_id"))
    out, level = owned, owned
    while True:
        level = cut(parents.join(level.select(F.col("id").alias("parent"), "owner_id"), "parent").select(F.col("to_id").alias("id"), "owner_id").join(out.select("id"), "id", "left_anti"))
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out


def propagate_min(edges: DataFrame, values: DataFrame, weight: Column | None = None) -> DataFrame:
    """(id, value): for every node the least value that reaches it along edges (from_id, to_id), a backward fixpoint.

    `values` (id, value) holds the fixed starts. With `weight`, a column of the edges that isn't null, the edge brings that
    value instead of its source's. The loop ends by itself: a node enters once and its value only falls afterwards. A null
    value travels too, but any other replaces it.
    """
    links = cut(edges.select("from_id", "to_id", (F.lit(None).cast("int") if weight is None else weight).alias("_w")).where(F.col("to_id").isNotNull()))
    fixed = links.where(F.col("_w").isNotNull()).select(F.col("to_id").alias("id"), F.col("_w").alias("value"))
    state = cut(values.select("id", "value").unionByName(fixed).groupBy("id").agg(F.min("value").alias("value")))
    frontier = state
    while not frontier.isEmpty():
        offered = links.where(F.col("_w").isNull()).join(frontier.select(F.col("id").alias("from_id"), "value"), "from_id").groupBy(F.col("to_id").alias("id")).agg(F.min("value").alias("value"))
        better = offered.join(state.select("id", F.struct("value").alias("_old")), "id", "left").where(F.col("_old").isNull() | (F.col("value").isNotNull() & (F.col("_old.value").isNull() | (F.col("value") < F.col("_old.value"))))).select("id", "value")
        frontier = cut(better)
        state = cut(state.unionByName(frontier).groupBy("id").agg(F.min("value").alias("value")))
    return state
