"""The prefix trie of conversations, as balanced parentheses per shard.

A conversation is the sequence of its turns, each as a 128-bit digest of role and text. All
sequences are put in order over the whole cluster and cut into shards of bounded size. A
shard writes its trie as parentheses: a node opens before its children and closes after them.

* Blocks of the running excess of opening over closing ones, with a tree of their minima,
  give ``find_close``: a subtree is what stands between a node and its close.
* The rank of "()" pairs counts the leaves in between, cumulative arrays in preorder the
  saved tokens.
* Only the nodes on the first and the last path of a shard can have members in other shards.
  These shared spines leave the shard as two paths, with what hangs below each node summed
  up, and meet in the next round, until one shard of bounded size holds them all.

So equal conversations, or a first turn that a third of all have, are split over shards like
any others, and no node is ever collected: ids that end at a spine node are digested as a
stream. A conversation's own list of digests is one row, as a document's text is.

Defined cases: rows without a conversation id are left out. Turns stand in the order of their
number, null first; equal numbers in the order of the SHA-256 of role and text. A null role or
text counts as empty. Repeated rows are repeated turns. Very long texts are digested and counted
whole. An empty table has no node, not even a root. Columns other than the four are not read,
so their names cannot clash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.llm.store import stored
from topicloom.scale import lookup_join

#: Turns of a shard, about; a shard has at least ``LEAST_PATHS`` paths, so that rounds end.
SHARD_TURNS = 1 << 17
LEAST_PATHS = 8

#: Words of a turn.
WORD = r"[^\x20\x09-\x0D]+"

_DIGEST = 16
_NODE, _SPINE, _ENDS = 0, 1, 2
_NO_ID = np.iinfo(np.int64).max
_LISTS = ("n", "words", "least", "kids", "leaves", "hang")
_TYPES = pa.schema([
    ("kind", pa.int32()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent", pa.int64()),
    ("parent_path", pa.binary()), ("n_convs", pa.int64()), ("n_children", pa.int64()),
    ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string()),
    ("path", pa.binary()), ("key", pa.binary()),
    *((name, pa.list_(pa.int64())) for name in _LISTS), ("ids", pa.string()),
])
_SCHEMA = (
    "kind int, conv_id long, depth long, parent long, parent_path binary, n_convs long, "
    "n_children long, n_leaves long, saved_tokens long, ends_sha256 string, path binary, "
    "key binary, " + ", ".join(f"{name} array<long>" for name in _LISTS) + ", ids string"
)
NODE_COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
                "saved_tokens", "ends_sha256")


class Parentheses:
    """A sequence of parentheses with blocks of least excess."""

    BLOCK = 256

    def __init__(self, is_open: np.ndarray) -> None:
        self.is_open = is_open
        self.excess = np.cumsum(np.where(is_open, 1, -1)).astype(np.int32)
        blocks = -(-len(is_open) // self.BLOCK)
        high = np.int32(np.iinfo(np.int32).max)
        rows = np.full(blocks * self.BLOCK, high, dtype=np.int32)
        rows[:len(is_open)] = self.excess
        self.rows = rows.reshape(blocks, self.BLOCK)
        self.leaves = 1 << max(blocks - 1, 0).bit_length()
        self.least = np.full(2 * self.leaves, high, dtype=np.int32)
        self.least[self.leaves:self.leaves + blocks] = self.rows.min(axis=1)
        at = self.leaves
        while at > 1:
            level = self.least[at:2 * at]
            at //= 2
            self.least[at:2 * at] = np.minimum(level[::2], level[1::2])
        pair = is_open & ~np.append(is_open[1:], True)
        self.pairs_to = np.cumsum(pair)

    def find_close(self, places: np.ndarray) -> np.ndarray:
        """The closing place of each opening one."""
        wanted = self.excess[places] - 1
        close = np.full(len(places), -1, dtype=np.int64)
        for low in range(0, len(places), 1 << 14):
            part = slice(low, low + (1 << 14))
            at, goal = places[part], wanted[part]
            found = self._in_block(at // self.BLOCK, goal, at % self.BLOCK)
            open_ = np.flatnonzero(found < 0)
            if len(open_):
                block = self._next_block(at[open_] // self.BLOCK, goal[open_])
                found[open_] = self._in_block(block, goal[open_], np.full(len(open_), -1))
            close[part] = found
        return close

    def _in_block(self, block: np.ndarray, goal: np.ndarray, after: np.ndarray) -> np.ndarray:
        """First place after ``after`` in the block with at most the goal, -1 if there is none."""
        fits = (self.rows[block] <= goal[:, None]) & (np.arange(self.BLOCK) > after[:, None])
        first = fits.argmax(axis=1)
        return np.where(fits[np.arange(len(block)), first], block * self.BLOCK + first, -1)

    def _next_block(self, block: np.ndarray, goal: np.ndarray) -> np.ndarray:
        """First later block with an excess of at most the goal: up the tree, then down."""
        node = block + self.leaves
        rising = np.ones(len(node), dtype=bool)
        while rising.any():
            left = rising & (node % 2 == 0)
            done = left.copy()
            done[left] = self.least[node[left] + 1] <= goal[left]
            node[done] += 1
            rising &= ~done
            node[rising] //= 2
        while True:
            inner = np.flatnonzero(node < self.leaves)
            if not len(inner):
                return node - self.leaves
            node[inner] *= 2
            right = inner[self.least[node[inner]] > goal[inner]]
            node[right] += 1

    def pairs_in(self, places: np.ndarray, closes: np.ndarray) -> np.ndarray:
        """Number of "()" between each place and its close."""
        return self.pairs_to[closes] - self.pairs_to[places] + (
            self.is_open[places] & ~self.is_open[np.minimum(places + 1, len(self.is_open) - 1)])


def _sums(values: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, dtype=np.int64), np.cumsum(values)])


class Shard:
    """The trie of a run of ordered paths.

    ``depth`` has the turns of each path; ``digests`` those turns one after another; ``lists``
    has, per path and depth from 0, what is known of that node: members, words of its turn,
    smallest member, and the children, leaves and savings below it that are not in the paths.
    """

    def __init__(self, depth: np.ndarray, digests: np.ndarray, lists: dict) -> None:
        self.depth = depth
        begin = _sums(depth)[:-1]
        self.begin, self.digests = begin, digests
        common = np.minimum(depth[1:], depth[:-1])
        row = np.repeat(np.arange(len(common)), common)
        turn = np.arange(common.sum()) - np.repeat(_sums(common)[:-1], common)
        differ = (digests[begin[row + 1] + turn] != digests[begin[row] + turn]).any(axis=1)
        shared = common.copy()
        np.minimum.at(shared, row[differ], turn[differ])
        self.shared = shared = np.concatenate([[-1], shared])

        new = depth - shared
        first = _sums(new)
        nodes = int(first[-1])
        self.entry = _sums(depth + 1)
        self.node_of = np.empty(int(self.entry[-1]), dtype=np.int64)
        self.parent = np.arange(-1, nodes - 1)
        stack = np.empty(int(depth.max()) + 1, dtype=np.int64)
        for i, (d, s) in enumerate(zip(depth.tolist(), shared.tolist())):
            if s < d:
                stack[s + 1:d + 1] = np.arange(first[i], first[i + 1])
                if s >= 0:
                    self.parent[first[i]] = stack[s]
            self.node_of[self.entry[i]:self.entry[i + 1]] = stack[:d + 1]
        level = np.arange(len(self.node_of)) - np.repeat(self.entry[:-1], depth + 1)
        self.level = np.empty(nodes, dtype=np.int64)
        self.level[self.node_of] = level

        # Each path closes what it does not share with the one before and opens its own.
        runs = np.empty(2 * len(depth) + 1, dtype=np.int64)
        runs[0:-1:2] = np.concatenate([[0], depth[:-1] - shared[1:]])
        runs[1::2], runs[-1] = new, depth[-1] + 1
        self.tree = Parentheses(np.repeat(np.arange(len(runs)) % 2 == 1, runs))
        places = np.flatnonzero(self.tree.is_open)
        closes = self.tree.find_close(places)
        self.end = np.arange(nodes) + (closes - places + 1) // 2

        self.n, self.kids_below, self.leaves_below, self.hang = (
            np.zeros(nodes, dtype=np.int64) for _ in range(4))
        for total, name in ((self.n, "n"), (self.kids_below, "kids"),
                            (self.leaves_below, "leaves"), (self.hang, "hang")):
            if name in lists:
                np.add.at(total, self.node_of, lists[name])
        self.words = np.zeros(nodes, dtype=np.int64)
        self.words[self.node_of] = lists["words"]
        self.least = np.full(nodes, _NO_ID)
        np.minimum.at(self.least, self.node_of, lists["least"])

        self.kids_here = np.bincount(self.parent[1:], minlength=nodes)
        self.is_leaf = (self.kids_here == 0) & (self.kids_below == 0)
        # A "()" whose node has children elsewhere is no leaf.
        false_pairs = _sums((self.kids_here == 0) & (self.kids_below > 0))
        below = _sums(self.leaves_below)
        own = np.arange(nodes)
        self.leaves = self.tree.pairs_in(places, closes) - (
            false_pairs[self.end] - false_pairs[own]) + below[self.end] - below[own]
        self.own_saving = (self.n - 1) * self.words
        savings = _sums(self.own_saving + self.hang)
        self.saved = savings[self.end] - savings[own]

    def path_nodes(self, path: int) -> np.ndarray:
        return self.node_of[self.entry[path]:self.entry[path + 1]]

    def path_key(self, path: int) -> bytes:
        return self.digests[self.begin[path]:self.begin[path] + self.depth[path]].tobytes()

    def names(self, paths) -> dict[int, bytes]:
        """Digest of the whole way to each node of the given paths."""
        out = {}
        for path in paths:
            key, way = self.path_key(path), hashlib.sha256()
            for place, node in enumerate(self.path_nodes(path).tolist()):
                if place:
                    way.update(key[(place - 1) * _DIGEST:place * _DIGEST])
                if node not in out:
                    out[node] = way.copy().digest()[:_DIGEST]
        return out

    def spines(self) -> dict[str, list]:
        """The first and the last path, as rows of the next round."""
        on = np.zeros(len(self.n), dtype=bool)
        paths = sorted({0, len(self.depth) - 1})
        for path in paths:
            on[self.path_nodes(path)] = True
        spine = np.flatnonzero(on)
        inner = spine[spine > 0]
        kids, leaves, hang = (np.zeros(len(self.n), dtype=np.int64) for _ in range(3))
        np.add.at(kids, self.parent[inner], 1)
        np.add.at(leaves, self.parent[inner], self.leaves[inner])
        np.add.at(hang, self.parent[inner], self.saved[inner])
        values = {
            "n": self.n, "words": self.words, "least": self.least,
            "kids": self.kids_here + self.kids_below - kids,
            "leaves": self.leaves - self.is_leaf - leaves,
            "hang": self.saved - self.own_saving - hang,
        }
        rows: dict[str, list] = {name: [] for name in ("key", *_LISTS)}
        told = np.zeros(len(self.n), dtype=bool)
        for path in paths:
            nodes = self.path_nodes(path)
            rows["key"].append(self.path_key(path))
            for name in _LISTS:
                known = values[name][nodes]
                if name != "words":
                    # What both paths share is told once.
                    known = np.where(told[nodes], _NO_ID if name == "least" else 0, known)
                rows[name].append(known)
            told[nodes] = True
        return rows


def _rows(count: int, **given) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(given[f.name], f.type) if f.name in given else pa.nulls(count, f.type)
         for f in _TYPES], schema=_TYPES)


def _shard_rows(shard: Shard, ids: np.ndarray | None, last: bool):
    """Rows of a shard: finished nodes, and what the next round needs unless it is the last.

    ``ids`` has the conversation that ends at each path, in the first round.
    """
    paths = [0, len(shard.depth) - 1]
    open_ = np.zeros(len(shard.n), dtype=bool)
    if not last:
        for path in paths:
            open_[shard.path_nodes(path)] = True
    # Nodes of later rounds may have children and ends that were told before.
    names = shard.names(range(len(shard.depth)) if ids is None else paths)
    digests = [None] * len(shard.n)
    if ids is not None:
        none = hashlib.sha256().hexdigest()
        digests = [none] * len(shard.n)
        tail = shard.node_of[shard.entry[1:] - 1]
        heads = np.flatnonzero(np.diff(tail, prepend=-1))
        for a, b in zip(heads, np.append(heads[1:], len(tail))):
            text, node = ",".join(map(str, ids[a:b].tolist())), int(tail[a])
            if open_[node]:
                yield _rows(1, kind=[_ENDS], path=[names[node]], conv_id=[ids[a]], ids=[text])
            else:
                digests[node] = hashlib.sha256(text.encode()).hexdigest()
    if not last:
        rows = shard.spines()
        yield _rows(len(rows["key"]), kind=[_SPINE] * len(rows["key"]), **rows)
    done = np.flatnonzero(~open_)
    parent = shard.parent[done]
    has = parent >= 0
    told = has & ~open_[parent]
    yield _rows(
        len(done), kind=np.full(len(done), _NODE), conv_id=shard.least[done],
        depth=shard.level[done],
        parent=[x if t else None for x, t in zip(shard.least[parent].tolist(), told)],
        parent_path=[None if t or not h else names[p]
                     for p, t, h in zip(parent.tolist(), told, has)],
        n_convs=shard.n[done],
        n_children=(shard.kids_here + shard.kids_below)[done], n_leaves=shard.leaves[done],
        saved_tokens=shard.saved[done], ends_sha256=[digests[n] for n in done],
        path=[names.get(n) for n in done.tolist()] if ids is None else [None] * len(done),
    )


def _shards(batches, most: float):
    """Cut ordered rows into tables of about ``most`` turns."""
    held, turns, paths = [], 0, 0
    for batch in batches:
        weights = np.cumsum(np.diff(np.asarray(batch.column("words").offsets)) + 1)
        start = 0
        while start < batch.num_rows:
            before = weights[start - 1] if start else 0
            stop = int(np.searchsorted(weights, before + max(most - turns, 0))) + 1
            stop = min(max(stop, start + LEAST_PATHS - paths, start + 1), batch.num_rows)
            held.append(batch.slice(start, stop - start))
            turns += int(weights[stop - 1] - before)
            paths += stop - start
            start = stop
            if turns >= most and paths >= LEAST_PATHS:
                yield pa.Table.from_batches(held).combine_chunks()
                held, turns, paths = [], 0, 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _flat(table: pa.Table, name: str) -> np.ndarray:
    column = table.column(name).combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def _read_shard(table: pa.Table) -> tuple[Shard, np.ndarray | None]:
    keys = table.column("key").to_pylist()
    depth = np.array([len(k) // _DIGEST for k in keys], dtype=np.int64)
    digests = np.frombuffer(b"".join(keys), dtype=np.uint64).reshape(-1, 2)
    if "n" in table.column_names:
        return Shard(depth, digests, {name: _flat(table, name) for name in _LISTS}), None
    ids = table.column("conv_id").to_numpy()
    words = np.zeros(int(depth.sum() + len(depth)), dtype=np.int64)
    inner = np.ones(len(words), dtype=bool)
    inner[_sums(depth + 1)[:-1]] = False
    words[inner] = _flat(table, "words")
    return Shard(depth, digests, {
        "n": np.ones(len(words), dtype=np.int64), "words": words,
        "least": np.repeat(ids, depth + 1),
    }), ids


def _round(rows: DataFrame, shard_turns: int, last: bool) -> DataFrame:
    """Shards of ordered rows to nodes, spines and ends."""

    def run(batches):
        for table in _shards(batches, float("inf") if last else shard_turns):
            shard, ids = _read_shard(table)
            yield from _shard_rows(shard, ids, last)

    return rows.mapInArrow(run, _SCHEMA)


def _end_digests(chunks: DataFrame) -> DataFrame:
    """(path, digest): SHA-256 of the ids that end at a spine node, as a stream in order."""

    def run(batches):
        path, digest = None, None
        for batch in batches:
            out = []
            for name, ids in zip(batch.column("path").to_pylist(), batch.column("ids").to_pylist()):
                if name != path:
                    if path is not None:
                        out.append((path, digest.hexdigest()))
                    path, digest = name, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield _digest_rows(out)
        if path is not None:
            yield _digest_rows([(path, digest.hexdigest())])

    ordered = chunks.select("path", "conv_id", "ids").repartition("path").sortWithinPartitions(
        "path", "conv_id")
    return ordered.mapInArrow(run, "path binary, digest string")


def _digest_rows(rows: list[tuple[bytes, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())],
        names=["path", "digest"])


def turn_lists(
    conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
    text: str = "text",
) -> DataFrame:
    """(conv_id, turns, words): ordered digests of the turns of each conversation, in hex."""
    said, by = (F.coalesce(F.col(c), F.lit("")) for c in (text, role))
    digest = F.sha2(F.concat(F.length(by).cast("string"), F.lit(":"), by, said), 256)
    rows = conversations.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv_id"),
        F.struct(F.col(turn).alias("turn"), digest.alias("digest"),
                 F.regexp_count(said, F.lit(WORD)).cast("long").alias("words")).alias("t"))
    lists = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return lists.select(
        "conv_id", F.transform("t", lambda t: F.substring(t["digest"], 1, 2 * _DIGEST)).alias(
            "turns"), F.transform("t", lambda t: t["words"]).alias("words"))


def with_shared_heads(lists: DataFrame, base: Column, heads: Column, most: int) -> DataFrame:
    """Replace the first ``heads`` (at most ``most``) turns by those of conversation ``base``.

    A base that is not there has no turns. ``base`` and ``heads`` are read from ``conv_id``.
    """
    first = lists.select(
        F.col("conv_id").alias("_base"), F.slice("turns", 1, most).alias("_turns"),
        F.slice("words", 1, most).alias("_words"))
    joined = lists.withColumn("_base", base).join(first, "_base", "left").withColumn("_h", heads)

    def rebuilt(name: str) -> Column:
        head = F.slice(F.coalesce(f"_{name}", F.slice(name, F.lit(1), F.lit(0))), F.lit(1),
                       F.col("_h"))
        return F.concat(head, F.slice(name, F.col("_h") + 1, F.size(name))).alias(name)

    return joined.select("conv_id", rebuilt("turns"), rebuilt("words"))


def prefix_trie(lists: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row per node of the trie of ``lists`` (conv_id, turns, words).

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256):
    smallest member, turns to the node, smallest member of its parent, members, children,
    leaves below or at it, words its subtree holds more than once, and the digest of the
    conversations that end there.
    """
    keyed = stored(lists.select(
        "conv_id", F.unhex(F.array_join("turns", "")).alias("key"), "words"), "trie-paths")
    # Equal conversations are cut apart by their ids.
    ordered = keyed.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    made = stored(_round(ordered, shard_turns, False), "trie-nodes")
    rounds = [made]
    while True:
        spines = made.where(F.col("kind") == _SPINE).select("key", *_LISTS)
        left = spines.agg(F.count("*").alias("paths"),
                          F.coalesce(F.sum(F.size("n")), F.lit(0)).alias("turns")).first()
        # The last round is one task, of spines within the bound of one shard.
        last = left.turns <= shard_turns or left.paths <= 4 * LEAST_PATHS
        parts = min(left.turns // (4 * shard_turns), left.paths // (4 * LEAST_PATHS)) + 1
        ordered = (spines.coalesce(1) if last else spines.withColumn(
            "_tie", F.xxhash64("least")).repartitionByRange(parts, "key", "_tie"))
        made = stored(_round(ordered.sortWithinPartitions("key").select("key", *_LISTS),
                             shard_turns, last), "trie-nodes")
        rounds.append(made)
        if last:
            break
    inner = rounds[0].where(F.col("kind") == _NODE)
    ends = _end_digests(rounds[0].where(F.col("kind") == _ENDS))
    upper = rounds[1].where(F.col("kind") == _NODE)
    for made in rounds[2:]:
        upper = upper.union(made.where(F.col("kind") == _NODE))
    upper = upper.join(ends, "path", "left").withColumn(
        "ends_sha256", F.coalesce("digest", F.sha2(F.lit(""), 256))).drop("digest")
    upper = stored(upper, "trie-spines")
    nodes = inner.unionByName(upper)
    parents = upper.select(F.col("path").alias("parent_path"), F.col("conv_id").alias("_up"))
    named = lookup_join(nodes.drop("path", "key", "ids", *_LISTS), parents, "parent_path", "left")
    return named.withColumn("parent_conv_id", F.coalesce("parent", "_up")).select(*NODE_COLUMNS)
