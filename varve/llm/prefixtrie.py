"""A trie of conversations by their turns, from vertical bitmaps.

Conversations in ascending order of id are dealt to shards by ranges of ids.  In a shard, every
(position, turn) has a bitset of the conversations that have that turn there, and every position
one of those that end there.  Depth first, a node's members (a bitset) meet the postings of the
next position: the lowest member left names a posting, the intersection with it is a child and
leaves the rest.  So each intersection yields one node, popcounts are members, the lowest bit is
the smallest id.

Shards are merged by a node's name, a 128-bit hash chained over the turns, so that a hot prefix
costs one row a shard.  What counts over subtrees (leaves, children, saved tokens) is counted in
the one shard that has the node's smallest member, by sums over the shard's own preorder, and
added up; so nothing walks the depth of the trie with a job a level.  Ids that end at a node are
listed per shard; as shards are ranges, the lists in order of their first ids are the whole list,
which is hashed as it streams by.

Results: turns of equal number go by the SHA-256 of role and text; rows without conv_id take no
part; a null role or text is empty, a null turn comes first; remainders are those of Spark and
SQL (-7 % 5 = -2).  One conversation's turns, 16 bytes each and no text, are one row.  An empty
table has no conversation and no root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from varve.llm.common import stored

# A shard ends at so many conversations, or at the conversation that reaches so many turns.
SHARD_CONVERSATIONS, SHARD_TURNS = 4_096, 32_768

SHARD_NODES = pa.schema([
    ("shard", pa.int64()), ("seq", pa.int32()), ("size", pa.int32()), ("depth", pa.int32()), ("node", pa.binary()),
    ("first", pa.int64()), ("n", pa.int64()), ("n_ends", pa.int64()), ("bytes", pa.int64()), ("ends", pa.string()),
])
SUMS = ("n_children", "n_leaves", "saved_tokens")
NODE = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, " + "".join(f"{c} bigint, " for c in SUMS) + "ends_sha256 string"


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, turns: array<struct<turn, id binary, bytes>> in order; one shuffle, of hashes, by groups of five ids."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    said = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    # The first half of the hash tells turns apart, the whole is never needed.
    turn = F.struct("turn", F.unhex(F.substring(F.sha2(said.cast("binary"), 256), 1, 32)).alias("id"), F.octet_length(text).alias("bytes"))
    rows = conversations.where(F.col("conv_id").isNotNull()).select("conv_id", turn.alias("turn"))
    rows = rows.select((F.col("conv_id") - F.col("conv_id") % 5).alias("base"), "conv_id", "turn").repartition("base")
    return rows.groupBy("base", "conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))


def rebuilt(turns: DataFrame) -> DataFrame:
    """Each conversation begins with the first h turns of its group's first one and goes on with its own after h."""
    head = turns.where(F.col("conv_id") == F.col("base")).select("base", F.slice("turns", 1, 8).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).cast("int")
    none = F.array().cast(turns.schema["turns"].dataType)
    begun = F.slice(F.coalesce("head", none), 1, h)
    rest = F.slice("turns", h + 1, F.size("turns"))
    whole = F.when(F.col("conv_id") == F.col("base"), F.col("turns")).otherwise(F.concat(begun, rest))
    return turns.join(head, "base", "left").select("conv_id", whole.alias("turns"))


def _bits(places: list[int]) -> int:
    if len(places) == 1:
        return 1 << places[0]
    flags = np.zeros(places[-1] + 1, dtype=np.uint8)
    flags[places] = 1
    return int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")


def _places(bits: int) -> list[int]:
    raw = np.frombuffer(bits.to_bytes(-(-bits.bit_length() // 8), "little"), dtype=np.uint8)
    return np.flatnonzero(np.unpackbits(raw, bitorder="little")).tolist()


def shard_nodes(ids: list[int], turns: list[list[bytes]], sizes: list[list[int]]) -> dict[str, list]:
    """The trie of one shard in preorder; ``ids`` ascend."""
    postings: dict[tuple, list[int]] = {}
    ended: dict[int, list[int]] = {}
    for i, said in enumerate(turns):
        ended.setdefault(len(said), []).append(i)
        for place, turn in enumerate(said):
            postings.setdefault((place, turn), []).append(i)
    bitsets = {key: _bits(places) for key, places in postings.items()}
    ends = {depth: _bits(places) for depth, places in ended.items()}

    out: dict[str, list] = {c: [] for c in ("depth", "node", "first", "n", "n_ends", "bytes", "ends")}
    # members, depth, name, bytes of the last turn
    stack = [((1 << len(ids)) - 1, 0, hashlib.blake2b(digest_size=16).digest(), 0)]
    while stack:
        members, depth, name, size = stack.pop()
        end = members & ends.get(depth, 0)
        lowest = (members & -members).bit_length() - 1
        out["depth"].append(depth)
        out["node"].append(name)
        out["first"].append(ids[lowest])
        out["n"].append(members.bit_count())
        out["n_ends"].append(end.bit_count())
        out["bytes"].append(size)
        out["ends"].append(",".join(str(ids[i]) for i in _places(end)) if end else None)
        left = members ^ end
        while left:
            i = (left & -left).bit_length() - 1
            turn = turns[i][depth]
            child = left & bitsets[depth, turn]
            stack.append((child, depth + 1, hashlib.blake2b(name + turn, digest_size=16).digest(), sizes[i][depth]))
            left ^= child
    return out


def subtree_sizes(depth: np.ndarray) -> np.ndarray:
    """Nodes in the subtree of each node of a preorder, itself included."""
    size, open_ = np.empty(len(depth), dtype=np.int64), []
    for at, d in enumerate(depth.tolist()):
        while len(open_) > d:
            begun = open_.pop()
            size[begun] = at - begun
        open_.append(at)
    for begun in open_:
        size[begun] = len(depth) - begun
    return size


def _sharded(whole: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        ids: list[int] = []
        turns: list[list[bytes]] = []
        sizes: list[list[int]] = []
        held = 0

        def shard() -> pa.RecordBatch:
            out = shard_nodes(ids, turns, sizes)
            n = len(out["depth"])
            number = [(part << 32) + made] * n
            size = subtree_sizes(np.array(out["depth"]))
            columns = {"shard": number, "seq": range(n), "size": size, **out}
            return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in SHARD_NODES], schema=SHARD_NODES)

        for batch in batches:
            for id_, said, long in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "ids", "sizes"))):
                ids.append(id_)
                turns.append(said)
                sizes.append(long)
                held += len(said)
                if held >= SHARD_TURNS or len(ids) >= SHARD_CONVERSATIONS:
                    yield shard()
                    made += 1
                    ids, turns, sizes, held = [], [], [], 0
        if ids:
            yield shard()

    flat = whole.select("conv_id", F.transform("turns", lambda t: t["id"]).alias("ids"), F.transform("turns", lambda t: t["bytes"]).alias("sizes"))
    schema = "shard bigint, seq int, size int, depth int, node binary, first bigint, n bigint, n_ends bigint, bytes bigint, ends string"
    return flat.repartitionByRange("conv_id").sortWithinPartitions("conv_id").mapInArrow(run, schema)


def _counted(nodes: DataFrame) -> DataFrame:
    """Per shard and node: what the shard adds to the node's sums, and the smallest member of the node's parent."""
    names = ["node", "depth", "first", "rep", "parent", "n_convs", *SUMS]
    kinds = [pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), *[pa.int64()] * len(SUMS)]

    def count(t: pa.Table) -> pa.RecordBatch:
        col = lambda c: t.column(c).to_numpy()
        depth, size, rep, n = col("depth"), col("size"), col("rep"), col("n_all")
        # Every node counts in the shard that has its smallest member.
        here = col("first") == rep
        parent = np.full(len(depth), -1)
        path: list[int] = []
        for at, d in enumerate(depth.tolist()):
            del path[d:]
            if path:
                parent[at] = path[-1]
            path.append(at)
        children = np.bincount(parent[here & (parent >= 0)], minlength=len(depth))
        at = np.arange(len(depth))

        def below(values: np.ndarray) -> np.ndarray:
            summed = np.concatenate([[0], np.cumsum(np.where(here, values, 0))])
            return summed[at + size] - summed[at]

        leaves, saved = below((n == col("n_ends_all")).astype(np.int64)), below((n - 1) * col("bytes"))
        # The root's turn has no bytes, so it saves nothing.
        above = pa.array(np.where(parent >= 0, rep[parent], 0), mask=parent < 0)
        made = [t.column("node").combine_chunks(), depth, col("first"), rep, above, n, children, leaves, saved]
        return pa.RecordBatch.from_arrays([m if isinstance(m, pa.Array) else pa.array(m, k) for m, k in zip(made, kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        shard = None
        for batch in batches:
            of = batch.column("shard").to_numpy()
            cuts = (np.flatnonzero(of[1:] != of[:-1]) + 1).tolist()
            for a, b in zip([0, *cuts], [*cuts, len(of)] if len(of) else []):
                if of[a] != shard and held:
                    yield count(pa.Table.from_batches(held))
                    held = []
                shard = of[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield count(pa.Table.from_batches(held))

    over = Window.partitionBy("node")
    merged = nodes.select(
        "shard", "seq", "size", "depth", "node", "first", "bytes",
        F.min("first").over(over).alias("rep"), F.sum("n").over(over).alias("n_all"), F.sum("n_ends").over(over).alias("n_ends_all"),
    )
    schema = "node binary, depth int, first bigint, rep bigint, parent bigint, n_convs bigint, " + ", ".join(f"{c} bigint" for c in SUMS)
    return merged.repartition("shard").sortWithinPartitions("shard", "seq").mapInArrow(run, schema)


def _summed(counted: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row per node: its shards' sums added, and their lists of ends hashed, as the rows stream by."""
    names = [f.split()[0] for f in NODE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, row, ends, listed = None, [], None, False
        done: list[list] = []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*done))
            kinds = [pa.int64()] * (len(names) - 1) + [pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in ("node", "depth", "rep", "parent", "n_convs", *SUMS, "ends"))):
                if r[0] != node:
                    if node is not None:
                        done.append([*row, ends.hexdigest()])
                    node, row, ends, listed = r[0], [r[2], r[1], r[3], r[4], 0, 0, 0], hashlib.sha256(), False
                for j in range(len(SUMS)):
                    row[4 + j] += r[5 + j]
                if r[-1] is not None:
                    ends.update(b"," * listed + r[-1].encode())
                    listed = True
            if done:
                yield flush()
                done = []
        if node is not None:
            done = [[*row, ends.hexdigest()]]
            yield flush()

    # A shard's counts come before its list of the same node.
    nothing = {c: F.lit(0).cast("bigint") for c in ("rep", "parent", "n_convs", *SUMS)}
    lists = nodes.where("ends IS NOT NULL").withColumns(nothing | {"listing": F.lit(True)})
    both = counted.withColumns({"listing": F.lit(False), "ends": F.lit(None).cast("string")})
    both = both.unionByName(lists.select(*both.columns))
    return both.repartition("node").sortWithinPartitions("node", "first", "listing").mapInArrow(run, NODE)


def trie(conversations: DataFrame) -> DataFrame:
    """Every node of the trie of rebuilt conversations: see the module's head; columns of ``NODE``."""
    nodes = stored(_sharded(rebuilt(turns_of(conversations))))
    return _summed(_counted(nodes), nodes)
