"""N-gram Jaccard join by PartEnum signatures, and the groups that its links form.

Every text becomes a set of hashed word shingles. Sets fall into size bands so that two
linked sets are in the same band or in adjacent ones. For a band the link threshold bounds
the number of elements by which two sets differ. The domain of the hashes is cut into
``first`` partitions of ``second`` parts each; a signature is the part of a set that falls
into a partition, without ``skipped`` of its parts, for every choice of skipped parts. The
numbers are chosen so that linked sets agree in at least so many signatures of elements as
can be told for each set alone; a set with fewer shared ones has no link there.

Documents that agree in a signature are compared with the smallest one of them. Where a
signature still joins different groups, they are compared with the one that has the fewest
elements of its own, and at last with all of other groups whose sizes, common elements and
number of shared signatures allow a link. So a group of n copies costs about n comparisons, and no link is lost.

Defined cases: A null or empty text, or one without words, has the empty set and links with
nothing. Rows with equal ``key`` are one document. A row with a null key takes part through
its text only: it gets the group of equal texts, or null if there is none. Repeated rows are
kept, each with its group. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations
from math import comb, exp

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.llm.blocks import blocks, bytes_in, find_words, lower_ascii, mix, shingle_hashes
from topicloom.llm.components import connected_components
from topicloom.llm.store import Scratch, stored
from topicloom.scale import keyed_join, lookup_join

#: Words are runs of anything but ASCII white space.
NOT_SPACE = ~bytes_in((0x20, 0x20), (0x09, 0x0D))
#: Elements of a set from which on its signatures are dealt to several chunks.
CHUNK = 256
#: Share of sets for which empty parts alone may be what two linked sets agree in.
RARE = 1e-6


@dataclass(frozen=True)
class Partitioning:
    """How the sets of one band and of the band below are cut."""

    first: int
    second: int
    skipped: int

    @property
    def subsets(self) -> list[tuple[int, ...]]:
        return list(combinations(range(self.second), self.second - self.skipped))


@dataclass(frozen=True)
class Scheme:
    """Size bands and partitionings for a link at ``percent`` percent similarity."""

    percent: int

    def band_ends(self, largest: int) -> list[int]:
        """Last size of each band; the first band starts at 1."""
        ends, start = [], 1
        while start <= largest:
            ends.append(max(start, start * 100 // self.percent))
            start = ends[-1] + 1
        return ends

    def partitioning(self, least: int, most: int) -> Partitioning:
        return _partitioning(self.percent, least, most)

    def spare(self, cut: Partitioning, size: int, most: int) -> int:
        """Partitions in which a set agrees with any linked one, beyond the first."""
        return _spare(self.percent, cut.first, cut.skipped, size, most)


def _spare(percent: int, first: int, skipped: int, size: int, most: int) -> int:
    """Of ``first`` partitions, those that the differences of linked sets must leave, less one.

    The other set has at most ``size * 100 / percent`` elements, and at most ``most``.
    """
    both = size + min(most, size * 100 // percent)
    differ = both * (100 - percent) // (100 + percent)
    return first - 1 - differ // (skipped + 1)


def _tail(mean: float, most: int) -> float:
    """Chance of more than ``most`` rare events where ``mean`` are expected."""
    term, tail = exp(-mean), 1.0
    for seen in range(most + 1):
        tail -= term
        term *= mean / (seen + 1)
    return max(tail, 0.0)


@lru_cache(maxsize=None)
def _partitioning(percent: int, least: int, most: int) -> Partitioning:
    """The cut with the fewest signatures for sets of ``least`` to ``most`` elements.

    Linked sets differ in at most ``differ`` elements, so that at most
    ``differ // (skipped + 1)`` partitions have more differences than parts may be skipped.
    Further partitions make up for those where a signature may be empty, so that sets of all
    sizes agree in one of elements, but for a share of ``RARE``.
    """
    differ = 2 * most * (100 - percent) // (100 + percent)
    sizes = {least, (3 * least + most) // 4, (least + most) // 2, (least + 3 * most) // 4, most}
    best, cost = None, None
    for skipped in range(0, min(differ, 4) + 1):
        for second in range(skipped + 1, skipped + 5):
            choices = comb(second, skipped)
            for more in (*range(60), *range(60, 600, 15)):
                first = differ // (skipped + 1) + 1 + more
                if cost is not None and first * choices >= cost:
                    break
                empty = {size: first * choices * exp(
                    -size * (second - skipped) / (first * second)) for size in sizes}
                if differ == 0 or all(
                    _tail(empty[size], _spare(percent, first, skipped, size, most)) <= RARE
                    for size in sizes
                ):
                    best, cost = Partitioning(first, second, skipped), first * choices
                    break
    if best is None:
        skipped = min(differ, 4)
        best = Partitioning(differ // (skipped + 1) + 1, skipped + 3, skipped)
    return best


def signatures(
    shingles: np.ndarray, instance: int, cut: Partitioning, spare: int
) -> tuple[np.ndarray, int]:
    """(signatures, needed) of one sorted set of distinct hashes under one instance.

    ``needed``: how many of them any linked set has as well, at least. Empty signatures are
    left out, unless the set has more partitions with empty ones than ``spare`` ones.
    """
    cells = cut.first * cut.second
    with np.errstate(over="ignore"):
        cell = ((shingles >> np.uint64(32)) * np.uint64(cells)) >> np.uint64(32)
        ends = np.searchsorted(cell, np.arange(cells + 1, dtype=np.uint64))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(shingles))])
        part = (sums[ends[1:]] - sums[ends[:-1]]).reshape(cut.first, cut.second)
        size = np.diff(ends).reshape(cut.first, cut.second)
        found, held = [], []
        for number, subset in enumerate(cut.subsets):
            chosen = list(subset)
            place = np.arange(cut.first, dtype=np.uint64) * np.uint64(64) + np.uint64(number)
            seed = mix(place + np.uint64(instance) * np.uint64(1 << 40))
            found.append(mix(part[:, chosen].sum(axis=1, dtype=np.uint64) + seed))
            held.append(size[:, chosen].sum(axis=1))
    found, held = np.array(found), np.array(held)
    empty = int((held == 0).any(axis=0).sum())
    if empty > spare:
        return found.ravel(), 1
    return found[held > 0], 1 + spare - empty


def shingle_sets(batches, key, text, words, extra=()):
    """Yield (rows, list of sorted distinct shingle hashes) per block of texts."""
    lower = lower_ascii()
    for rows, data, offsets in blocks(batches, text):
        found = find_words(lower[data], offsets, NOT_SPACE)
        hashes, first = shingle_hashes(found, words)
        yield rows, [np.unique(hashes[a:b]) for a, b in zip(first[:-1], first[1:])]


def set_sizes(docs: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """(key, n_shingles, low, high) per row; low and high identify the set."""

    def run(batches):
        for rows, sets in shingle_sets(batches, key, text, words):
            with np.errstate(over="ignore"):
                low = np.array([mix(s).sum(dtype=np.uint64) for s in sets], dtype=np.uint64)
                high = np.array([mix(s ^ np.uint64(0x5DEECE66D)).sum(dtype=np.uint64)
                                 for s in sets], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [rows.column(key), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array(low.view(np.int64)), pa.array(high.view(np.int64))],
                names=[key, "n_shingles", "low", "high"],
            )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(
        run, f"`{key}` {kind}, n_shingles long, low long, high long"
    )


def signature_rows(docs: DataFrame, key: str, text: str, words: int, percent: int) -> DataFrame:
    """(sig, doc, info, more) rows: documents of one block that share ``sig``.

    ``info`` is twice the number of signatures that a link needs, plus one for the own band,
    and in its upper 8 bits how often those of the instance are halved for ``_chunks``;
    ``more`` has (doc, info) of further documents, null if there are none. Rows are as small
    as can be, and those of a document stand together, so that they compress well.

    An instance of the scheme is for the sets of its own band and of the band below; two
    sets of the band below are compared in their own instance. The first document of a
    block, if possible one of the own band, stands for the others, so a hot
    signature is one row per block and not one per document.
    """

    def run(batches):
        scheme = Scheme(percent)
        ends = np.array(scheme.band_ends(1 << 34))
        starts = np.concatenate([[1], ends[:-1] + 1])
        for rows, sets in shingle_sets(batches, key, text, words):
            keys = rows.column(key)
            parts, seen = [], set()
            for k, s in zip(keys.to_pylist(), sets):
                if k is None or not len(s):
                    continue
                same = (len(s), s.tobytes())
                if same in seen:
                    # Equal sets are grouped by their identity already.
                    continue
                seen.add(same)
                band = int(np.searchsorted(ends, len(s)))
                for i in (band, band + 1):
                    least = int(starts[i - 1]) if i else 1
                    most = int(ends[i])
                    cut = scheme.partitioning(least, most)
                    spare = scheme.spare(cut, len(s), most)
                    found, needed = signatures(s, i, cut, spare)
                    halved = min((most // CHUNK).bit_length(), 30)
                    parts.append((found, k, (halved << 24) + 2 * needed + (i == band)))
            if not parts:
                continue
            sizes = [len(found) for found, _, _ in parts]
            sig = np.concatenate([found for found, _, _ in parts]) >> np.uint64(16)
            doc = np.repeat(np.array([k for _, k, _ in parts], dtype=np.int64), sizes)
            info = np.repeat(np.array([x for _, _, x in parts], dtype=np.int32), sizes)
            place = np.arange(len(sig))
            order = np.lexsort((doc, 1 - info % 2, sig))
            sig, doc, info, place = sig[order], doc[order], info[order], place[order]
            first = np.concatenate([[True], sig[1:] != sig[:-1]])
            head_of = np.cumsum(first) - 1
            heads = np.flatnonzero(first)
            back = np.argsort(place[heads], kind="stable")
            rank = np.empty(len(heads), dtype=np.int64)
            rank[back] = np.arange(len(heads))
            rest = np.flatnonzero(~first)
            rest = rest[np.argsort(rank[head_of[rest]], kind="stable")]
            others = np.bincount(rank[head_of[rest]], minlength=len(heads))
            offsets = pa.array(np.concatenate([[0], np.cumsum(others)]).astype(np.int32))
            further = pa.StructArray.from_arrays(
                [pa.array(doc[rest]), pa.array(info[rest])], names=["doc", "info"])
            more = pa.ListArray.from_arrays(offsets, further, mask=pa.array(others == 0))
            heads = heads[back]
            yield pa.RecordBatch.from_arrays(
                [pa.array(sig[heads].view(np.int64)), pa.array(doc[heads]),
                 pa.array(info[heads]), more],
                names=["sig", "doc", "info", "more"],
            )

    narrow = docs.select(F.col(key).cast("long").alias(key), F.col(text).alias(text))
    return narrow.mapInArrow(
        run, "sig long, doc long, info int, more array<struct<doc: bigint, info: int>>"
    )


def shared_members(rows: DataFrame, alias: DataFrame) -> DataFrame:
    """(sig, doc, own, needed, parts): signatures that may join two documents, with them.

    At least one of them is of the own band. A document stays in an instance only if it has
    as many such signatures there as any link needs. ``alias`` names the documents that
    another one with an equal set stands for.
    """
    found = rows.selectExpr(
        "sig", "doc", "info", "more", "count(1) over (partition by sig) as blocks",
        "max(info % 2) over (partition by sig) as any_own",
    ).where("any_own = 1 and (blocks > 1 or more is not null)")
    none = F.array().cast("array<struct<doc: bigint, info: int>>")
    members = F.concat(F.array(F.struct("doc", "info")), F.coalesce("more", none))
    each = found.select("sig", F.explode(members).alias("m")).select(
        "sig", "m.doc", (F.col("m.info") % 2 == 1).alias("own"),
        F.shiftright("m.info", 1).bitwiseAND((1 << 23) - 1).alias("needed"),
        F.shiftright("m.info", 24).alias("parts"),
    )
    # No document is hot: it has a bounded number of signatures.
    each = keyed_join(each, alias, "doc", "left").select(
        F.coalesce("rep", "doc").alias("doc"), "sig", "own", "needed", "parts")
    # Dealt once, for the distinct rows and for their number.
    each = each.repartition("doc", "own").distinct()
    counted = each.selectExpr(
        "sig", "doc", "own", "needed", "parts", "count(1) over (partition by doc, own) as n")
    return counted.where("n >= needed").drop("n")


def _verified(
    pairs: DataFrame, sets: DataFrame, percent: int, scratch: Scratch
) -> DataFrame:
    """Pairs (a, b) that link: common share of their sets is at least ``percent`` percent.

    Short codes of the elements go first: equal elements have equal codes, so they give an
    upper bound of what is common, and only pairs that reach the share get their whole sets.
    """

    @F.arrow_udf("boolean")
    def may(left: pa.Array, right: pa.Array) -> pa.Array:
        out = []
        seen = np.zeros(1 << 16, dtype=bool)
        for x, y in zip(left, right):
            a = np.frombuffer(x.as_buffer(), dtype=np.uint16)
            b = np.frombuffer(y.as_buffer(), dtype=np.uint16)
            seen[b] = True
            both = int(seen[a].sum())
            seen[b] = False
            both = min(both, len(b))
            out.append(both > 0 and 100 * both >= percent * (len(a) + len(b) - both))
        return pa.array(out, pa.bool_())

    @F.arrow_udf("boolean")
    def linked(left: pa.Array, right: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(left, right):
            a = np.frombuffer(x.as_buffer(), dtype=np.uint64)
            b = np.frombuffer(y.as_buffer(), dtype=np.uint64)
            place = np.searchsorted(b, a)
            place[place == len(b)] = 0
            both = int((b[place] == a).sum())
            out.append(both > 0 and 100 * both >= percent * (len(a) + len(b) - both))
        return pa.array(out, pa.bool_())

    def with_both(pairs: DataFrame, column: str) -> DataFrame:
        # Only the sets of these pairs move: the list is sent where its measured size allows.
        named = pairs.select(F.col("a").alias("doc")).union(pairs.select("b")).distinct()
        own = lookup_join(sets.select("doc", column), scratch.keep(named, "jaccard-named"), "doc",
                          "left_semi")
        left = own.select(F.col("doc").alias("a"), F.col(column).alias("left"))
        right = own.select(F.col("doc").alias("b"), F.col(column).alias("right"))
        return pairs.select("a", "b").join(left, "a").join(right, "b")

    pairs = scratch.keep(pairs.select("a", "b"), "jaccard-pairs")
    near = with_both(pairs, "codes").where(may("left", "right"))
    near = scratch.keep(near.select("a", "b").distinct(), "jaccard-near")
    return with_both(near, "shingles").where(linked("left", "right")).select("a", "b").distinct()


def _sets_of(docs: DataFrame, wanted: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """(doc, size, shingles, codes): the sets of the wanted documents, as bytes.

    ``codes`` has the upper 16 bits of each element.
    """

    def run(batches):
        for rows, sets in shingle_sets(batches, "doc", text, words):
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc"), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([s.tobytes() for s in sets], pa.binary()),
                 pa.array([(s >> np.uint64(48)).astype(np.uint16).tobytes() for s in sets],
                          pa.binary())],
                names=["doc", "size", "shingles", "codes"],
            )

    # The list is sent where its measured size allows, so only the chosen texts move.
    named = docs.select(F.col(key).cast("long").alias("doc"), text)
    chosen = lookup_join(named, wanted, "doc", "left_semi")
    return chosen.dropDuplicates(["doc"]).mapInArrow(
        run, "doc long, size long, shingles binary, codes binary")


def jaccard_groups(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    words: int = 5,
    percent: int = 80,
) -> DataFrame:
    """(key, n_shingles, n_links, component_id) per row of ``docs``.

    ``component_id`` is the smallest key that is reachable by links, itself included.
    ``n_links`` counts the verified links of the document's set that were needed to find
    the groups: a lower bound of all its links, 0 only if it has none.
    """
    scratch = Scratch(docs.sparkSession)
    sized = scratch.keep(set_sizes(docs, key, text, words), "jaccard-sizes")
    # Equal sets: the smallest key stands for all.
    named = sized.where("n_shingles > 0").groupBy("n_shingles", "low", "high").agg(
        F.min(F.col(key).cast("long")).alias("rep")
    )
    rows = sized.join(named, ["n_shingles", "low", "high"], "left")
    rows = stored(
        rows.select(key, "n_shingles", F.coalesce("rep", F.col(key).cast("long")).alias("rep")),
        "jaccard-rows",
    )
    alias = rows.where(F.col(key).cast("long") != F.col("rep")).select(
        F.col(key).cast("long").alias("doc"), "rep"
    ).distinct()

    members = scratch.keep(
        shared_members(signature_rows(docs, key, text, words, percent), alias),
        "jaccard-members",
    )
    centers = members.groupBy("sig").agg(
        F.min(F.when(F.col("own"), F.col("doc"))).alias("least"), F.count("*").alias("n")
    ).where("least is not null and n > 1").select("sig", "least")
    stars = members.join(centers, "sig").where("doc <> least")
    edges = scratch.keep(
        stars.groupBy(F.col("doc").alias("a"), F.col("least").alias("b")).count(), "jaccard-edges"
    )
    wanted = edges.select(F.col("a").alias("doc")).union(edges.select("b")).distinct()
    sets = scratch.keep(_sets_of(docs, wanted, key, text, words), "jaccard-sets")

    # First the most promising comparison of each document, then what is still apart.
    best = edges.groupBy("a").agg(F.max_by("b", F.struct("count", -F.col("b"))).alias("b"))
    links = scratch.keep(_verified(best, sets, percent, scratch), "jaccard-links")
    groups = connected_components(links)
    apart = _apart(edges.select("a", "b").join(best, ["a", "b"], "anti"), groups)
    more = scratch.keep(_verified(apart, sets, percent, scratch), "jaccard-links")
    links = links.union(more)
    groups = connected_components(links)
    open_ = scratch.keep(_open_members(members, groups), "jaccard-open")
    named = scratch.keep(open_.select("doc").distinct(), "jaccard-named")
    bounds = scratch.keep(_bounds(named, sets, percent), "jaccard-bounds")
    hubs = scratch.keep(_hub_pairs(open_, bounds, percent), "jaccard-hubs")
    more = scratch.keep(_verified(hubs, sets, percent, scratch), "jaccard-links")
    links = links.union(more)
    groups = connected_components(links)
    open_ = scratch.keep(_open_members(open_.drop("label"), groups), "jaccard-open")
    rest = _between_groups(open_, bounds, percent)
    tested = edges.select("a", "b").union(hubs.select("a", "b"))
    rest = rest.join(tested, ["a", "b"], "anti")
    more = scratch.keep(_verified(rest, sets, percent, scratch), "jaccard-links")
    links = links.union(more)
    groups = connected_components(links)

    ends = links.select(F.col("a").alias("rep")).union(links.select("b"))
    degree = ends.groupBy("rep").agg(F.count("*").alias("n_links"))
    labels = stored(groups.withColumnRenamed("node", "rep").join(degree, "rep"),
                    "jaccard-groups")
    scratch.clear()
    return rows.join(labels, "rep", "left").select(
        key, "n_shingles", F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("label", "rep").alias("component_id"),
    )


def _apart(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """Pairs (a, b) that are not in one group."""
    a = groups.select(F.col("node").alias("a"), F.col("label").alias("group_a"))
    b = groups.select(F.col("node").alias("b"), F.col("label").alias("group_b"))
    joined = pairs.join(a, "a", "left").join(b, "b", "left")
    return joined.where(
        F.coalesce("group_a", "a") != F.coalesce("group_b", "b")
    ).select("a", "b")


def _open_members(members: DataFrame, groups: DataFrame) -> DataFrame:
    """(sig, doc, own, needed, parts, label): members of signatures that still join different groups."""
    labelled = members.join(groups.withColumnRenamed("node", "doc"), "doc", "left").select(
        "sig", "doc", "own", "needed", "parts", F.coalesce("label", "doc").alias("label")
    )
    mixed = labelled.groupBy("sig").agg(F.min("label").alias("x"), F.max("label").alias("y"))
    return labelled.join(mixed.where("x <> y").select("sig"), "sig")


def _bounds(named: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(doc, size, most) of the named open documents that may link with another one.

    Elements that no other open document has cannot be common ones; ``most`` is what is
    left. A copy with many changes of its own is no candidate, however many copies there are.
    """

    def elements(batches):
        for rows in batches:
            column = rows.column("shingles")
            found = [np.frombuffer(x.as_buffer(), dtype=np.int64) for x in column]
            ends = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
            flat = np.concatenate(found) if found else np.empty(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc"), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                names=["doc", "elements"],
            )

    # Sets move at most once: the list is sent where its measured size allows.
    wanted = keyed_join(sets.select("doc", "shingles"), named, "doc", "left_semi")
    single = wanted.mapInArrow(elements, "doc long, elements array<long>").select(
        "doc", F.explode("elements").alias("element")
    ).groupBy("element").agg(F.min("doc").alias("doc"), F.count("*").alias("n")).where("n = 1")
    single = single.groupBy("doc").agg(F.count("*").alias("single"))
    sizes = keyed_join(sets.select("doc", "size"), named, "doc", "left_semi")
    bounds = sizes.join(single, "doc", "left").select(
        "doc", "size", (F.col("size") - F.coalesce("single", F.lit(0))).alias("most")
    )
    may_link = F.col("most") * 100 >= F.col("size") * percent
    return bounds.where(may_link)


def _may_link(percent: int):
    """Whether the sizes of two sets, and what may be common, allow a link."""
    both = F.least("most_a", "most_b")
    return both * 100 >= (F.col("size_a") + F.col("size_b") - both) * percent


def _side(near: DataFrame, name: str) -> DataFrame:
    """The columns of one side of a pair."""
    return near.select("sig", F.col("doc").alias(name), *(
        F.col(c).alias(f"{c}_{name}") for c in ("label", "size", "most")))


def _hub_pairs(open_: DataFrame, bounds: DataFrame, percent: int) -> DataFrame:
    """One pair for each open document: with the hub of a signature, of another group.

    The hub has the least share of elements of its own, as what others are copied from.
    """
    near = open_.join(bounds, "doc")
    common = F.col("most") / F.col("size")
    hubs = near.groupBy("sig").agg(F.max_by(
        F.struct("doc", "label", "size", "most"), F.struct(common, -F.col("doc"))).alias("hub"))
    hubs = hubs.select("sig", F.col("hub.doc").alias("doc"), F.col("hub.label").alias("label"),
                       F.col("hub.size").alias("size"), F.col("hub.most").alias("most"))
    pairs = _side(near, "a").join(_side(hubs, "b"), "sig").where("label_a <> label_b")
    pairs = pairs.where(_may_link(percent))
    best = F.struct(F.col("most_b") / F.col("size_b"), -F.col("b"))
    return pairs.groupBy("a").agg(F.max_by("b", best).alias("b"))


def _chunks(near: DataFrame) -> DataFrame:
    """(sig, doc, own, label, size, most, needed, rest, sigs): a row per signature and document.

    ``sigs`` has the signatures of the document in one of the ``2 ** parts`` chunks into which
    a hash deals those of an instance, in order, and ``rest`` is how many it has in the others.
    A chunk holds few however long the document is, so that the rows stay small.
    """
    chunk = F.pmod(F.hash("sig"), F.expr("shiftleft(1, parts)"))
    counted = near.select("*", chunk.alias("chunk"), F.expr(
        "count(1) over (partition by doc, own)").alias("n"), F.expr(
        "min(needed) over (partition by doc, own)").alias("least"))
    each = counted.groupBy("doc", "own", "parts", "chunk").agg(
        F.sort_array(F.collect_set("sig")).alias("sigs"), F.min("n").alias("n"),
        F.min("least").alias("needed"), F.min("label").alias("label"),
        F.min("size").alias("size"), F.min("most").alias("most"))
    return each.where("n >= needed").select(
        F.explode("sigs").alias("sig"), "doc", "own", "label", "size", "most", "needed",
        (F.col("n") - F.size("sigs")).alias("rest"), "sigs")


def _between_groups(open_: DataFrame, bounds: DataFrame, percent: int) -> DataFrame:
    """Pairs of different groups that share as many signatures as a link needs, and may link.

    All signatures that documents of two groups share are open, so a pair with fewer of
    them than one of the two needs has no link. A pair comes from the smallest one of each
    chunk, and only where the other chunks could hold what is missing.
    """
    near = _chunks(open_.join(bounds, "doc"))

    def side(name: str) -> DataFrame:
        return near.select("sig", F.col("doc").alias(name), *(
            F.col(c).alias(f"{c}_{name}")
            for c in ("own", "label", "size", "most", "sigs", "needed", "rest")))

    common = F.array_intersect("sigs_a", "sigs_b")
    needed = F.greatest("needed_a", "needed_b")
    first = (F.array_min(common) == F.col("sig")) & (
        F.size(common) + F.least("rest_a", "rest_b") >= needed)
    may = (F.col("a") > F.col("b")) & (F.col("label_a") != F.col("label_b")) & _may_link(percent)
    pairs = side("a").withColumnRenamed("sig", "_sig").join(
        side("b"), (F.col("_sig") == F.col("sig")) & may & first)
    shared = pairs.select("a", "b", "own_a", "own_b", needed.alias("needed"),
                          F.size(common).alias("shared"))
    shared = shared.groupBy("a", "b", "own_a", "own_b").agg(
        F.sum("shared").alias("shared"), F.max("needed").alias("needed"))
    return shared.where("shared >= needed").select("a", "b").distinct()


def keep_one(docs: DataFrame, groups: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stand for their group: those with the smallest key.

    Repeated rows of that key are one document and only one of them stays. Rows with a
    null key stay.
    """
    kept = groups.where(F.col(key) == F.col("component_id")).select(key).distinct()
    first = docs.join(kept, key, "semi").dropDuplicates([key])
    return first.unionByName(docs.where(F.col(key).isNull()))


def keep_one_row(
    docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80
) -> DataFrame:
    """One row of ``docs`` of each group of near duplicates, whatever their keys.

    Rows are linked by their own texts under a written row key. The row with the smallest
    key stays, one with a null key only if no other is in the group. Of rows without words
    all stay but repeats of a key and text.
    """
    rows = stored(docs.withColumn("_row", F.monotonically_increasing_id()), "jaccard-keyed")
    groups = jaccard_groups(rows, "_row", text, words, percent)
    named = groups.join(rows.select("_row", key), "_row")
    order = F.struct(F.col(key).isNull().alias("lost"), F.col(key).alias("key"), "_row")
    first = named.groupBy("component_id").agg(
        F.min(order)["_row"].alias("_row"), F.max("n_shingles").alias("n_shingles"))
    # One bit per row, so that lists of rows are small enough to be sent and no text moves.
    has_words, place = F.col("n_shingles") > 0, F.bitmap_bit_position("_row")
    bits = stored(first.groupBy(F.bitmap_bucket_number("_row").alias("_row_bucket")).agg(
        F.bitmap_construct_agg(F.when(has_words, place)).alias("_row_kept"),
        F.bitmap_construct_agg(F.when(~has_words, place)).alias("_row_wordless")), "jaccard-first")
    marked = lookup_join(
        rows.withColumn("_row_bucket", F.bitmap_bucket_number("_row")), bits, "_row_bucket")
    kept = marked.where(_bit("_row_kept", place))
    wordless = marked.where(_bit("_row_wordless", place))
    named_once = wordless.where(F.col(key).isNotNull()).dropDuplicates([key, text])
    return kept.unionByName(named_once).unionByName(
        wordless.where(F.col(key).isNull())).select(*docs.columns)


def _bit(bitmap: str, place: Column) -> Column:
    """Whether the bit at a place of a bitmap of ``bitmap_construct_agg`` is set."""
    byte = F.substring(bitmap, (F.shiftright(place, 3) + 1).cast("int"), 1)
    return F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), (place % 8).cast("int")) == 1
