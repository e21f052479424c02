"""Operator 10: resharding by minimum-cost flow."""

from __future__ import annotations

import math
import uuid
from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import shared_dir

#: Blocks into which an old shard is cut to find where its bytes part; 2^_KEY_BITS keys order its documents.
BLOCKS = 1 << 12
_KEY_BITS = 60
#: Empty shards that the production query adds to the old ones, all of one capacity.
NEW_SHARDS = 4
SEED = "shard-1"
#: Bytes of text a file of a rewritten shard.
FILE_BYTES = 128 << 20


def min_cost_flow(sizes: dict[str, int], capacities: dict[str, int]) -> list[tuple[str, str, int]]:
    """(old, new, bytes) flows that place all bytes within the capacities and move the fewest.

    A primal-dual flow on source -> old -> new -> sink, where staying costs 0 and every move runs over one hub
    edge of cost 1: so edges grow with the shards and not with their pairs, and a phase sends all it can along
    shortest paths, each edge looked at once. What passes the hub is matched in label order. Raises ValueError
    if the capacities can't hold the bytes.
    """
    if sum(sizes.values()) > sum(capacities.values()):
        raise ValueError("the new capacities hold less than the old shards")
    olds, news = sorted(sizes), sorted(capacities)
    node = {("o", x): k + 3 for k, x in enumerate(olds)} | {("n", x): k + 3 + len(olds) for k, x in enumerate(news)}
    src, hub, sink = 0, 1, 2
    to, room, cost, adj = [], [], [], [[] for _ in range(3 + len(node))]

    def edge(a: int, b: int, cap: int, c: int) -> int:
        for x, y, r, w in ((a, b, cap, c), (b, a, 0, -c)):
            adj[x].append(len(to))
            to.append(y), room.append(r), cost.append(w)
        return len(to) - 2

    stay, out, into = {}, {}, {}
    for x in olds:
        edge(src, node["o", x], sizes[x], 0)
        if x in capacities:
            stay[x] = edge(node["o", x], node["n", x], sizes[x], 0)
        out[x] = edge(node["o", x], hub, sizes[x], 1)
    for x in news:
        into[x] = edge(hub, node["n", x], capacities[x], 0)
        edge(node["n", x], sink, capacities[x], 0)
    while True:
        dist, queue = {src: 0}, deque([src])
        while queue:  # label-correcting: residual costs may be -1
            a = queue.popleft()
            for e in adj[a]:
                if room[e] and dist[a] + cost[e] < dist.get(to[e], math.inf):
                    dist[to[e]] = dist[a] + cost[e]
                    queue.append(to[e])
        if sink not in dist:
            break
        # all paths of that length; edges of cost 0 may lead in circles, so a node is entered once a path
        nxt, path, on, gone = [0] * len(adj), [], {src}, set()
        a = src
        while True:
            if a == sink:
                push = min(room[e] for e in path)
                for e in path:
                    room[e] -= push
                    room[e ^ 1] += push
                k = next(k for k, e in enumerate(path) if not room[e])
                for e in path[k:]:
                    on.discard(to[e])
                a = to[path[k] ^ 1]
                del path[k:]
                continue
            while nxt[a] < len(adj[a]):
                e = adj[a][nxt[a]]
                if room[e] and to[e] not in on and to[e] not in gone and dist.get(to[e]) == dist[a] + cost[e]:
                    break
                nxt[a] += 1
            else:
                if a == src:
                    break
                gone.add(a)
                on.discard(a)
                a = to[path.pop() ^ 1]
                continue
            path.append(e)
            a = to[e]
            on.add(a)
    flows = [(x, x, room[e ^ 1]) for x, e in stay.items() if room[e ^ 1]]
    gives = deque((x, room[e ^ 1]) for x, e in sorted(out.items()) if room[e ^ 1])
    takes = deque((x, room[e ^ 1]) for x, e in sorted(into.items()) if room[e ^ 1])
    while gives and takes:
        (a, g), (b, t) = gives.popleft(), takes.popleft()
        flows.append((a, b, min(g, t)))
        if g > t:
            gives.appendleft((a, g - t))
        elif t > g:
            takes.appendleft((b, t - g))
    return flows


_NO_ID = -(1 << 63)


def _key(doc_id: Column, seed: str) -> Column:
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, _KEY_BITS // 4), 16, 10).cast("long")


def _cuts(light: DataFrame, flows: list[tuple[str, str, int]], blocks: int) -> dict[str, list[tuple[int, int, str]]]:
    """Old shard -> (key, id, new shard) from which on, in the order of keys and ids, its documents go to a shard.

    light: shard, key, id, bytes. The bytes of a flow begin within one block of keys; the first document that
    begins at or after them is found among that block's documents, so no task orders a whole shard.
    """
    cuts: dict[str, list[tuple[int, int, str]]] = {}
    at: dict[str, int] = {}
    inner = []
    for old, new, size in flows:
        lo = at.get(old, 0)
        at[old] = lo + size
        if lo == 0:
            cuts.setdefault(old, []).append((-1, _NO_ID, new))
        else:
            inner.append((old, new, lo))
    if not inner:
        return cuts
    spark = light.sparkSession
    wide = (1 << _KEY_BITS) // blocks
    light = light.withColumn("block", F.floor(F.col("key") / F.lit(wide)))
    sums = light.groupBy("shard", "block").agg(F.sum("bytes").alias("bytes"))
    upto = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumn("end", F.sum("bytes").over(upto)).withColumn("base", F.col("end") - F.col("bytes"))
    wanted = F.broadcast(spark.createDataFrame(inner, "old string, new string, lo long"))  # a row a flow, from the driver
    split = sums.join(wanted, (F.col("shard") == F.col("old")) & (F.col("base") < F.col("lo")) & (F.col("lo") <= F.col("end"))).select("shard", "block", "base", "new", "lo")
    docs = light.join(F.broadcast(split), ["shard", "block"]).groupBy("shard", "new", "lo", "base", "key", "id").agg(F.sum("bytes").alias("bytes"))
    before = Window.partitionBy("shard", "new").orderBy("key", "id").rowsBetween(Window.unboundedPreceding, -1)
    begun = docs.withColumn("begin", F.col("base") + F.coalesce(F.sum("bytes").over(before), F.lit(0))).where("begin >= lo")
    first = {(r.shard, r.new): r.x for r in begun.groupBy("shard", "new").agg(F.min(F.struct("key", "id")).alias("x")).collect()}
    for r in split.collect():
        x = first.get((r.shard, r.new))
        cuts[r.shard].append((x.key, x.id, r.new) if x else ((r.block + 1) * wide, _NO_ID, r.new))
    return cuts


def assign(
    docs: DataFrame, shard_col: str = "source", capacities: dict[str, int] | None = None, new_shards: int = NEW_SHARDS, blocks: int = BLOCKS, seed: str = SEED
) -> DataFrame:
    """docs with old_shard, new_shard (strings) and moved (boolean): the plan that moves the fewest bytes.

    Each value of shard_col is an old shard; its bytes are the UTF-8 bytes of text. capacities gives the
    bytes that each new shard may hold; without it, the old shards and new_shards empty ones (named new0,
    new1, ...) share all bytes evenly. The flows are solved exactly for shard totals. An old shard's documents,
    in the order of a hash of doc_id, are laid end to end; those that begin within the bytes that stay do stay, and
    the rest go to the shard in whose part of the flow they begin. So a new shard exceeds its capacity by less than
    a document for each flow into it. Only sums of shards and where flows begin reach the driver; texts aren't shuffled.

    A null shard is the shard ''. Null text has 0 bytes; rows without doc_id are placed like one id, repeated
    doc_ids stay together in their shard. Ties don't arise: documents of one hash are ordered by doc_id. An empty
    table gives no rows. Columns of docs named old_shard, new_shard or moved are replaced. The number of blocks
    affects speed only.
    """
    cols = [c for c in docs.columns if c not in ("old_shard", "new_shard", "moved")]
    old = F.coalesce(F.col(f"`{shard_col}`").cast("string"), F.lit(""))
    ident = F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID))
    spark = docs.sparkSession
    light = docs.select(old.alias("shard"), _key(F.col("doc_id"), seed).alias("key"), ident.alias("id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"))
    sizes = {r[0]: r[1] for r in light.groupBy("shard").agg(F.sum("bytes")).collect()}
    if capacities is None:
        names = sorted(sizes) + [f"new{k}" for k in range(new_shards)]
        capacities = {s: math.ceil(sum(sizes.values()) / len(names)) for s in names} if sizes else {}
    flows = min_cost_flow(sizes, capacities)
    placed = {x for x, _, _ in flows}
    flows += [(x, x if x in capacities else sorted(capacities)[0], 0) for x in sizes if x not in placed]  # documents without a byte
    cuts = _cuts(light, flows, blocks)
    schema = T.StructType([T.StructField("__shard", T.StringType()), T.StructField("__cuts", T.ArrayType(T.StructType([T.StructField("key", T.LongType()), T.StructField("id", T.LongType()), T.StructField("to", T.StringType())])))])
    plan = F.broadcast(spark.createDataFrame([(x, sorted(c)) for x, c in cuts.items()], schema))  # a row a shard and a cut a flow, from the driver
    key = _key(F.col("doc_id"), seed)
    new = F.element_at(F.filter("__cuts", lambda c: (c["key"] < F.col("__key")) | ((c["key"] == F.col("__key")) & (c["id"] <= F.col("__id")))), -1)["to"]
    tagged = docs.select("*", old.alias("__old"), key.alias("__key"), ident.alias("__id")).join(plan, F.col("__old") == F.col("__shard"))
    return tagged.select(*[F.col(f"`{c}`") for c in cols], F.col("__old").alias("old_shard"), new.alias("new_shard"), (F.col("__old") != new).alias("moved"))


def _rewrite(placed: DataFrame, root: str, files_a_shard: int = 1) -> list[str]:
    """Write the rows of the shards that gain or lose some as folders under root, drop the folders of shards left empty."""
    pairs = placed.select("old_shard", "new_shard").distinct().collect()
    touched = sorted({x for r in pairs if r.old_shard != r.new_shard for x in r})
    rows = placed.where(F.col("new_shard").isin(touched)) if touched else placed.limit(0)
    rows = rows.repartition(max(1, len(touched)) * files_a_shard, "new_shard", F.pmod(F.xxhash64("doc_id"), F.lit(files_a_shard)))
    rows.drop("old_shard", "moved").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("new_shard").parquet(root)
    # dynamic overwrite leaves a folder that gets no row as it is; its rows lie in other shards now
    jvm, conf = placed.sparkSession._jvm, placed.sparkSession._jsc.hadoopConfiguration()
    for shard in set(touched) - {r.new_shard for r in pairs}:
        folder = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString("new_shard", shard)
        path = jvm.org.apache.hadoop.fs.Path(root, folder)
        path.getFileSystem(conf).delete(path, True)
    return touched


def rewrite(docs: DataFrame, root: str, files_a_shard: int = 1, **params) -> list[str]:
    """Write docs under root as new_shard=... folders, but only those that gain or lose rows; returns their names.

    docs must have been read from elsewhere than root (or root from a snapshot): changed folders are overwritten
    as a whole, those of shards that lose all rows are deleted, the others are left as they lie.
    """
    return _rewrite(assign(docs, **params), root, files_a_shard)


def resharded(docs: DataFrame, shard_col: str = "source", **params) -> DataFrame:
    """assign() carried out: the affected shards are written into the shared folder, and their rows are what was written.

    Rows of shards that neither gain nor lose any aren't written; they come from the plan. A file holds about
    FILE_BYTES of text.
    """
    placed = assign(docs, shard_col, **params)
    root = f"{shared_dir(docs.sparkSession)}/shards-{uuid.uuid4().hex}"
    n, shards = placed.agg(F.sum(F.octet_length("text").cast("long")), F.count_distinct("new_shard")).first()
    kept = [c for c in placed.columns if c not in ("old_shard", "new_shard", "moved")]
    written = placed.withColumn("__old", F.col("old_shard"))
    touched = _rewrite(written, root, max(1, math.ceil((n or 0) / max(1, shards) / FILE_BYTES)))
    if not touched:
        return placed
    schema = T.StructType([*written.drop("old_shard", "new_shard", "moved").schema.fields, T.StructField("new_shard", T.StringType())])
    back = docs.sparkSession.read.schema(schema).parquet(root)
    old, new = F.coalesce("__old", F.lit("")), F.coalesce("new_shard", F.lit(""))  # a folder can't be named ''
    back = back.select(*kept, old.alias("old_shard"), new.alias("new_shard"), (old != new).alias("moved"))
    return back.unionByName(placed.where(~F.col("new_shard").isin(touched)))


def sharded(docs: DataFrame, **params) -> DataFrame:
    """doc_id, old_shard, new_shard and moved for every row of docs, the affected shards rewritten (see resharded)."""
    return resharded(docs, **params).select("doc_id", "old_shard", "new_shard", "moved")


def sql(tail: str = "select doc_id, old_shard, new_shard, old_shard <> new_shard moved from placed", docs: str = "documents") -> str:
    """The same plan as interval arithmetic: with costs of 0 and 1, matching surplus to room in label order is optimal."""
    return f"""
with tagged as (
  select *, coalesce(source, '') old_shard, cast('0x' || substr(md5('{SEED}:' || coalesce(cast(doc_id as varchar), '')), 1, {_KEY_BITS // 4}) as bigint) key,
    coalesce(octet_length(encode(text)), 0) bytes from {docs}),
cells as (select old_shard, key, doc_id, cast(sum(bytes) as bigint) bytes from tagged group by all),
starts as (select *, cast(coalesce(sum(bytes) over (partition by old_shard order by key, doc_id nulls first rows between unbounded preceding and 1 preceding), 0) as bigint) begin_at from cells),
sizes as (select old_shard shard, cast(sum(bytes) as bigint) size from cells group by all),
names as (select shard, size from sizes union all select 'new' || range, 0 from range({NEW_SHARDS}) where exists (select 1 from sizes)),
caps as (select shard, size, cast(ceil((select sum(size) from sizes) / (select count(*) from names)) as bigint) cap from names),
gives as (select shard, least(size, cap) stay, greatest(size - cap, 0) n, sum(greatest(size - cap, 0)) over (order by shard) hi from caps),
takes as (select shard, greatest(cap - size, 0) n, sum(greatest(cap - size, 0)) over (order by shard) hi from caps),
flows as (
  select g.shard old_shard, t.shard new_shard, g.stay + greatest(g.hi - g.n, t.hi - t.n) - (g.hi - g.n) lo
  from gives g join takes t on g.n > 0 and t.n > 0 and g.hi > t.hi - t.n and t.hi > g.hi - g.n
  union all select shard, shard, 0 from gives),
dest as (select s.old_shard, s.key, s.doc_id, max_by(f.new_shard, f.lo) new_shard from starts s join flows f on f.old_shard = s.old_shard and f.lo <= s.begin_at group by all),
placed as (select t.* exclude (key, bytes), d.new_shard from tagged t join dest d on t.old_shard = d.old_shard and t.key = d.key and t.doc_id is not distinct from d.doc_id)
{tail}"""
