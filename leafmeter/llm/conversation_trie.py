"""Z-fast trie over conversations: the prefix tree of their turns, compacted, with hashed handles.

A compacted node stands for one edge: the prefixes longer than its parent's extent (``up`` turns) and at most as
long as its own (``depth`` turns).  Its handle is the prefix whose length is the two-fattest number of that range, the
one divisible by the highest power of two.  A conversation finds the place where it leaves the trie by binary search
over two-fattest lengths, each a lookup of one of its prefixes among the handles, so it takes a logarithm of its
turns in rounds.  Conversations are inserted in batches; only what a batch adds below its exit places is new.

Prefixes go by (length, 128-bit digest).  The digest is a sum over (place, turn) that running totals over ranges give,
so a conversation with any number of turns is never held by one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from leafmeter.functions.ordered import running_total
from leafmeter.llm.common import stored

#: Batches in which distinct conversations are inserted.
BATCHES = 2
#: Search rounds planned together; the state is stored between.
ROUNDS_AT_ONCE = 3
#: Turns of an edge unfolded by one array.
EDGE_PART = 1024
#: Ids that one row of a list of ids holds.
CHUNK_IDS = 4096

_LANES = ("s1", "s2", "s3", "s4")
_KEY = ["depth", "a", "b"]
_NODE = ["depth", "a", "b", "up", "ua", "ub", "rep", "upto", "up_upto"]


def turns(rows: DataFrame) -> DataFrame:
    """``conv_id, pos, s1..s4 parts, size`` of every turn: its place from 1, its digest and its text's UTF-8 bytes.

    Turns are ordered by ``turn``, NULL first, and equal ones by their content's digest; NULL role or text counts as
    empty, repeated rows are turns of their own, and rows without ``conv_id`` belong to no conversation.  Other columns
    are ignored.
    """
    role, text = (F.coalesce(rows[c].cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    base = rows.filter(rows["conv_id"].isNotNull()).select(
        rows["conv_id"].cast("long").alias("conv_id"),
        rows["turn"].cast("long").alias("turn"),
        digest.alias("digest"),
        F.octet_length(text).cast("long").alias("size"),
        F.lit(1).cast("long").alias("one"),
    )
    placed = running_total(base, ["conv_id"], [F.asc_nulls_first("turn"), F.asc("digest")], {"one": "pos"})
    return placed.select("conv_id", "pos", "digest", "size")


def _digest(sums: list[Column]) -> list[Column]:
    return [F.xxhash64(F.lit(i), *sums).alias(n) for i, n in ((1, "a"), (2, "b"))]


def prefixes(placed: DataFrame) -> DataFrame:
    """Every non-empty prefix of every conversation: ``conv_id, depth, a, b``, the prefix one turn shorter ``pa, pb``,
    the last text's ``size`` and all texts' bytes ``upto``.  ``placed`` holds ``conv_id, pos, digest, size`` with the places
    1 to the number of turns."""
    words = [F.xxhash64(F.lit(k), "pos", "digest") for k in (1, 2)]
    parts = [f(w) for w in words for f in (lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF)), lambda x: F.shiftrightunsigned(x, 32))]
    rows = placed.select("conv_id", "pos", "size", *[p.alias(f"x{s}") for p, s in zip(parts, _LANES)])
    summed = running_total(rows, ["conv_id"], [F.asc("pos")], {**{f"x{s}": s for s in _LANES}, "size": "upto"})
    sums = [F.col(s) for s in _LANES]
    before = [F.col(s) - F.col(f"x{s}") for s in _LANES]
    shorter = [c.alias(n) for c, n in zip(_digest(before), ("pa", "pb"))]
    return summed.select("conv_id", F.col("pos").alias("depth"), *_digest(sums), *shorter, "size", "upto")


def _root() -> list[Column]:
    return [F.lit(0).cast("long").alias("depth"), *_digest([F.lit(0).cast("long")] * 4)]


def paths(convs: DataFrame, prefix_rows: DataFrame) -> DataFrame:
    """``conv_id, depth, a, b, upto`` of every conversation of ``convs`` (conv_id): its whole sequence; without turns, the
    root."""
    last = prefix_rows.groupBy("conv_id").agg(F.max_by(F.struct(*_KEY, "upto"), "depth").alias("w"))
    depth, a, b = _root()
    zero = F.lit(0).cast("long")
    return convs.join(last, "conv_id", "left").select(
        "conv_id",
        F.coalesce("w.depth", depth).alias("depth"),
        F.coalesce("w.a", a).alias("a"),
        F.coalesce("w.b", b).alias("b"),
        F.coalesce("w.upto", zero).alias("upto"),
    )


def two_fattest(low: Column, high: Column) -> Column:
    """The number in (low, high] divisible by the highest power of two; low < high."""
    keep = F.length(F.bin(low.bitwiseXOR(high))) - 1
    return F.call_function("shiftleft", F.call_function("shiftright", high, keep), keep)


# ---- search


def locate(nodes: DataFrame, strings: DataFrame, prefix_rows: DataFrame) -> DataFrame:
    """Where every path of ``strings`` (conv_id, depth) leaves the trie, by fat binary search.

    Gives ``conv_id, depth, at, ka, kb``, the longest prefix that the trie has, and the edge it lies within: the node
    ``w_depth, w_a, w_b, w_up, w_ua, w_ub, w_rep, ...``, NULL where the path leaves at a node's extent.
    """
    own = prefix_rows.select("conv_id", F.col("depth").alias("d"), "a", "b", "upto")
    root = _root()
    state = strings.select(
        "conv_id",
        "depth",
        F.lit(0).cast("long").alias("low"),
        F.col("depth").alias("high"),
        root[1].alias("ka"),
        root[2].alias("kb"),
        F.lit(0).cast("long").alias("k_upto"),
    )
    handles = nodes.filter("depth > 0").select(
        F.col("h").alias("f"), F.col("ha").alias("fa"), F.col("hb").alias("fb"), F.col("depth").alias("e"), F.col("a").alias("ea"),
        F.col("b").alias("eb"), F.col("up").alias("e_up"), F.col("ua").alias("e_ua"), F.col("ub").alias("e_ub"), F.col("up_upto").alias("e_up_upto"),
    )
    # A trie of the root alone has nothing to search.
    bare = nodes.filter("depth > 0").isEmpty()
    rounds = 0 if bare else int(strings.agg(F.max("depth")).first()[0] or 0).bit_length()
    for done in range(rounds):
        state = _round(state, handles, own)
        if done + 1 < rounds and (done + 1) % ROUNDS_AT_ONCE == 0:
            state = stored(state, "search")
            if state.filter("low < high").isEmpty():
                break
    # The child by the next turn, if any, holds the rest of the match.
    name = own.select(F.col("conv_id").alias("n_conv"), F.col("d").alias("n_d"), F.col("a").alias("na"), F.col("b").alias("nb"))
    below = nodes.filter("depth > 0").select(
        (F.col("up") + 1).alias("c_d"), F.col("na").alias("c_a"), F.col("nb").alias("c_b"),
        *[F.col(c).alias(f"w_{c}") for c in _NODE],
    )
    found = stored(
        state.join(name, (F.col("conv_id") == F.col("n_conv")) & (F.col("low") + 1 == F.col("n_d")))
        .join(below, (F.col("n_d") == F.col("c_d")) & (F.col("na") == F.col("c_a")) & (F.col("nb") == F.col("c_b")))
        .select("conv_id", "low", *[f"w_{c}" for c in _NODE]),
        "edges",
    )
    mine = found.select("conv_id", "low", "w_rep", F.col("w_depth").alias("edge_end")).join(
        own, "conv_id"
    ).filter("d > low AND d <= edge_end")
    theirs = own.select(F.col("conv_id").alias("t_conv"), F.col("d").alias("t_d"), F.col("a").alias("ta"), F.col("b").alias("tb"))
    same = mine.join(
        theirs, (F.col("w_rep") == F.col("t_conv")) & (F.col("d") == F.col("t_d")) & (F.col("a") == F.col("ta")) & (F.col("b") == F.col("tb"))
    )
    reach = same.groupBy("conv_id").agg(F.max_by(F.struct("d", "a", "b", "upto"), "d").alias("m"))
    edges = found.drop("low").join(reach, "conv_id")
    out = state.join(edges, "conv_id", "left")
    return out.select(
        "conv_id",
        "depth",
        F.coalesce("m.d", "low").alias("at"),
        F.coalesce("m.a", "ka").alias("ka"),
        F.coalesce("m.b", "kb").alias("kb"),
        F.coalesce("m.upto", "k_upto").alias("k_upto"),
        *[f"w_{c}" for c in _NODE],
    )


def _round(state: DataFrame, handles: DataFrame, own: DataFrame) -> DataFrame:
    """One step of the search.  A path that is done probes the length -1, which no prefix has, so it stays with its own id
    and idle rows do not meet under one key."""
    open_ = F.col("low") < F.col("high")
    probe = F.when(open_, two_fattest(F.col("low"), F.col("high"))).otherwise(-1).cast("long")
    at_probe = own.select(F.col("conv_id").alias("p_conv"), F.col("d").alias("p_d"), F.col("a").alias("p_a"), F.col("b").alias("p_b"))
    at_extent = own.select(
        F.col("conv_id").alias("x_conv"), F.col("d").alias("x_d"), F.col("a").alias("x_a"), F.col("b").alias("x_b"), F.col("upto").alias("x_upto")
    )
    probed = state.withColumn("probe", probe).join(
        at_probe, (F.col("conv_id") == F.col("p_conv")) & (F.col("probe") == F.col("p_d")), "left"
    ).withColumns({"p_a": F.coalesce("p_a", "conv_id"), "p_b": F.coalesce("p_b", "conv_id")})
    hit = probed.join(handles, (F.col("probe") == F.col("f")) & (F.col("p_a") == F.col("fa")) & (F.col("p_b") == F.col("fb")), "left")
    checked = hit.withColumn("e_at", F.coalesce("e", F.lit(-1))).join(
        at_extent, (F.col("conv_id") == F.col("x_conv")) & (F.col("e_at") == F.col("x_d")), "left"
    )
    whole = F.coalesce((F.col("x_a") == F.col("ea")) & (F.col("x_b") == F.col("eb")), F.lit(False))
    part = F.col("e").isNotNull()
    # A handle of the path whose extent is not: the path leaves on this edge, behind the node's parent.
    step = {
        "low": F.when(whole, F.col("e")).when(part, F.col("e_up")).otherwise(F.col("low")),
        "high": F.when(whole, F.col("high")).when(part, F.col("e_up")).when(open_, F.col("probe") - 1).otherwise(F.col("high")),
        "ka": F.when(whole, F.col("ea")).when(part, F.col("e_ua")).otherwise(F.col("ka")),
        "kb": F.when(whole, F.col("eb")).when(part, F.col("e_ub")).otherwise(F.col("kb")),
        "k_upto": F.when(whole, F.col("x_upto")).when(part, F.col("e_up_upto")).otherwise(F.col("k_upto")),
    }
    return checked.select("conv_id", "depth", *[c.alias(n) for n, c in step.items()])


# ---- insertion


def empty_trie(prefix_rows: DataFrame) -> DataFrame:
    """A trie of the textless root alone."""
    none = [F.lit(None).cast("long").alias(c) for c in ("up", "ua", "ub", "rep")]
    zero = [F.lit(0).cast("long").alias(c) for c in ("upto", "up_upto")]
    hashed = [F.lit(None).cast("long").alias(c) for c in ("h", "ha", "hb", "na", "nb")]
    return prefix_rows.sparkSession.range(1).select(*_root(), *none, *zero, *hashed)


def _hashed(nodes: DataFrame, prefix_rows: DataFrame) -> DataFrame:
    """Nodes with their handle ``h, ha, hb`` and their name ``na, nb``, the prefix one turn longer than the parent's."""
    own = prefix_rows.select("conv_id", F.col("depth").alias("d"), F.col("a").alias("oa"), F.col("b").alias("ob"))
    nodes = nodes.withColumns({"h": two_fattest(F.col("up"), F.col("depth")), "first": F.col("up") + 1})
    for at, x, y in (("h", "ha", "hb"), ("first", "na", "nb")):
        one = own.select(F.col("conv_id").alias("o_conv"), F.col("d").alias("o_d"), F.col("oa").alias(x), F.col("ob").alias(y))
        nodes = nodes.join(one, (F.col("rep") == F.col("o_conv")) & (F.col(at) == F.col("o_d"))).drop("o_conv", "o_d")
    return nodes.select(*_NODE, "h", "ha", "hb", "na", "nb")


def insert(nodes: DataFrame, strings: DataFrame, prefix_rows: DataFrame) -> DataFrame:
    """The trie with the distinct paths ``strings`` (conv_id, depth, a, b) inserted; ``prefix_rows`` hold the prefixes of these
    and of all paths inserted before.

    An edge is cut wherever a path leaves it.  Below the exit places, a prefix at which paths of the batch part, or at
    which one ends, becomes a node.
    """
    exits = stored(locate(nodes, strings, prefix_rows), "exits")
    # Cut edges.
    cut = exits.filter("w_depth IS NOT NULL AND at < w_depth")
    points = cut.groupBy("at", "ka", "kb").agg(
        F.min("k_upto").alias("upto"), *[F.min(f"w_{c}").alias(f"w_{c}") for c in _NODE]
    )
    ends = points.select(*[f"w_{c}" for c in _NODE]).distinct()
    along = points.select(F.col("at").alias("depth"), F.col("ka").alias("a"), F.col("kb").alias("b"), "upto", *[f"w_{c}" for c in _NODE]).unionByName(
        ends.select(*[F.col(f"w_{c}").alias(c) for c in ("depth", "a", "b", "upto")], *[f"w_{c}" for c in _NODE])
    )
    edge = Window.partitionBy("w_depth", "w_a", "w_b").orderBy("depth")
    above = F.lag(F.struct(F.col("depth").alias("up"), F.col("a").alias("ua"), F.col("b").alias("ub"), F.col("upto").alias("up_upto"))).over(edge)
    given = F.struct(F.col("w_up").alias("up"), F.col("w_ua").alias("ua"), F.col("w_ub").alias("ub"), F.col("w_up_upto").alias("up_upto"))
    pieces = along.withColumn("over", F.coalesce(above, given)).select(
        *_KEY, "over.up", "over.ua", "over.ub", F.col("w_rep").alias("rep"), "upto", "over.up_upto"
    )
    # New material.
    own = prefix_rows.select("conv_id", F.col("depth").alias("d"), "a", "b", "pa", "pb", "upto")
    place = exits.select("conv_id", F.col("depth").alias("last"), "at", "ka", "kb", "k_upto")
    rest = stored(own.join(place, "conv_id").filter("d > at"), "rest")
    distinct = rest.groupBy("d", "a", "b").agg(
        F.first("pa").alias("pa"), F.first("pb").alias("pb"), F.bool_or(F.col("d") == F.col("last")).alias("ends")
    )
    kids = distinct.groupBy((F.col("d") - 1).alias("d"), F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count("*").alias("kids"))
    marks = distinct.filter("ends").select("d", "a", "b").union(kids.filter("kids > 1").select("d", "a", "b")).distinct()
    on_path = rest.join(marks, ["d", "a", "b"], "left_semi")
    path = Window.partitionBy("conv_id").orderBy("d")
    above = F.lag(F.struct(F.col("d").alias("up"), F.col("a").alias("ua"), F.col("b").alias("ub"), F.col("upto").alias("up_upto"))).over(path)
    given = F.struct(F.col("at").alias("up"), F.col("ka").alias("ua"), F.col("kb").alias("ub"), F.col("k_upto").alias("up_upto"))
    grown = (
        on_path.withColumn("over", F.coalesce(above, given))
        .groupBy(F.col("d").alias("depth"), "a", "b")
        .agg(F.min(F.struct("conv_id", "over", "upto")).alias("w"))
        .select(*_KEY, "w.over.up", "w.over.ua", "w.over.ub", F.col("w.conv_id").alias("rep"), "w.upto", "w.over.up_upto")
    )
    fresh = _hashed(pieces.select(*_NODE).unionByName(grown.select(*_NODE)), prefix_rows)
    gone = ends.select(F.col("w_depth").alias("depth"), F.col("w_a").alias("a"), F.col("w_b").alias("b"))
    return stored(nodes.join(gone, _KEY, "left_anti").unionByName(fresh), "trie")


def build(strings: DataFrame, prefix_rows: DataFrame, batches: int = BATCHES) -> DataFrame:
    """The compacted nodes of the trie of ``strings`` (conv_id, depth, a, b), distinct paths, inserted in batches."""
    dealt = strings.filter("depth > 0").withColumn("batch", F.pmod(F.xxhash64("conv_id"), F.lit(batches)))
    nodes = empty_trie(prefix_rows)
    for i in range(batches):
        nodes = insert(nodes, dealt.filter(F.col("batch") == i).drop("batch"), prefix_rows)
    return nodes


# ---- statistics


def _subtrees(nodes: DataFrame, own: dict[str, Column], least: str) -> DataFrame:
    """Sums of the columns ``own`` and the least of ``least`` over every node's subtree, itself included.

    Pointers to ancestors double their reach each round, and a node's sums go to the ancestor just beyond what it has
    covered, so rounds are the logarithm of the height and a node with many children gets partial sums.
    """
    names = list(own)
    cur = stored(nodes.select(*_KEY, F.col("up").alias("g"), F.col("ua").alias("ga"), F.col("ub").alias("gb"), least, *[c.alias(n) for n, c in own.items()]), "sums")
    while not cur.filter("g IS NOT NULL").isEmpty():
        given = cur.filter("g IS NOT NULL").groupBy(F.col("g").alias("depth"), F.col("ga").alias("a"), F.col("gb").alias("b")).agg(
            *[F.sum(n).alias(f"d_{n}") for n in names], F.min(least).alias("d_least")
        )
        summed = cur.join(given, _KEY, "left").select(
            *_KEY, "g", "ga", "gb", F.least(least, "d_least").alias(least), *[(F.col(n) + F.coalesce(f"d_{n}", F.lit(0))).alias(n) for n in names]
        )
        # The root has no ancestor, so pointers to it, which may be most, need no lookup.
        over = cur.filter("g IS NOT NULL").select(F.col("depth").alias("g"), F.col("a").alias("ga"), F.col("b").alias("gb"), F.col("g").alias("o"), F.col("ga").alias("oa"), F.col("gb").alias("ob"))
        far = summed.filter("g > 0").join(over, ["g", "ga", "gb"], "left").select(
            *_KEY, F.col("o").alias("g"), F.col("oa").alias("ga"), F.col("ob").alias("gb"), least, *names
        )
        none = F.lit(None).cast("long")
        near = summed.filter("coalesce(g, 0) = 0").withColumns({"g": none, "ga": none, "gb": none})
        cur = stored(far.unionByName(near.select(far.columns)), "sums")
    return cur.drop("g", "ga", "gb")


def trie_statistics(nodes: DataFrame, prefix_rows: DataFrame, ended: DataFrame) -> DataFrame:
    """The nodes of the uncompacted tree, edges unfolded to one row per prefix: ``conv_id`` (the smallest member), ``depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved, a, b``.

    ``ended`` holds ``conv_id, depth, a, b, upto`` of every conversation, copies included.  ``saved`` sums, over the
    prefix and all below, the bytes of the last text times the members but one.
    """
    here = ended.groupBy(*_KEY).agg(F.count("*").alias("n"), F.min("conv_id").alias("least"), F.min("upto").alias("total"))
    kids = nodes.filter("up IS NOT NULL").groupBy(F.col("up").alias("depth"), F.col("ua").alias("a"), F.col("ub").alias("b")).agg(F.count("*").alias("kids"))
    zero = F.lit(0).cast("long")
    full = stored(nodes.join(here, _KEY, "left").join(kids, _KEY, "left").withColumn("kids", F.coalesce("kids", zero)), "nodes")
    own = {
        "n": F.coalesce("n", zero),
        "bytes": F.coalesce(F.col("n") * F.col("total"), zero),
        "edge": F.col("upto") - F.col("up_upto"),
        "leaves": (F.col("kids") == 0).cast("long"),
    }
    sums = stored(_subtrees(full, own, "least"), "subtrees")
    over = sums.select(F.col("depth").alias("up"), F.col("a").alias("ua"), F.col("b").alias("ub"), F.col("least").alias("above"))
    full = stored(full.drop("n", "least").join(sums, _KEY).join(over, ["up", "ua", "ub"], "left"), "nodes")
    # An edge is unfolded in parts, so no array grows with a conversation.
    part = F.explode(F.sequence(zero, F.floor((F.col("depth") - F.col("up") - 1) / EDGE_PART)))
    first = F.col("up") + F.col("part") * EDGE_PART
    edges = full.filter("depth > 0").withColumn("part", part).withColumn(
        "at", F.explode(F.sequence(first + 1, F.least(first + EDGE_PART, F.col("depth"))))
    ).drop("a", "b", "upto")
    own_rows = prefix_rows.select(F.col("conv_id").alias("rep"), F.col("depth").alias("at"), "a", "b", "size", "upto")
    rows = edges.join(own_rows, ["rep", "at"])
    inner = F.col("at") < F.col("depth")
    before = F.col("upto") - F.col("size")
    saved = (F.col("bytes") - F.col("n") * before) - (F.col("edge") - (before - F.col("up_upto")))
    below = rows.select(
        F.col("least").alias("conv_id"),
        F.col("at").alias("depth"),
        F.when(F.col("at") > F.col("up") + 1, F.col("least")).otherwise(F.col("above")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.when(inner, 1).otherwise(F.col("kids")).cast("long").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        saved.alias("saved"),
        "a",
        "b",
    )
    # Without conversations there is no root either.
    top = full.filter("depth = 0 AND n > 0").select(
        F.col("least").alias("conv_id"), "depth", F.lit(None).cast("long").alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.col("kids").alias("n_children"), F.col("leaves").alias("n_leaves"), (F.col("bytes") - F.col("edge")).alias("saved"), "a", "b",
    )
    return below.unionByName(top)


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted ids of each key joined by commas, at most ``CHUNK_IDS`` to a row."""
    for batch in batches:
        ids = batch.column("conv_id").to_pylist()
        keys = np.stack([batch.column(c).to_numpy() for c in _KEY], axis=1)
        new = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)])) if len(ids) else np.zeros(0, int)
        begin = [i for a, b in zip(new.tolist(), [*new[1:].tolist(), len(ids)]) for i in range(a, b, CHUNK_IDS)]
        joined = [",".join(map(str, ids[a:b])) for a, b in zip(begin, _ends(begin, new.tolist(), len(ids)))]
        take = pa.array(begin, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column(c).take(take) for c in (*_KEY, "conv_id")] + [pa.array(joined, pa.string())], names=[*_KEY, "first", "ids"]
        )


def _ends(begin: list[int], new: list[int], n: int) -> list[int]:
    return [min(b, a + CHUNK_IDS) for a, b in zip(begin, [*begin[1:], n])]


def _hash_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each key's rows, joined by commas in their order; only the running hash is held."""
    key, running = None, None
    for batch in batches:
        done = []
        for *own, ids in zip(*[batch.column(c).to_pylist() for c in (*_KEY, "ids")]):
            if own != key:
                if key is not None:
                    done.append((*key, running.hexdigest()))
                key, running = own, hashlib.sha256(ids.encode())
            else:
                running.update(b"," + ids.encode())
        yield _hash_rows(done)
    if key is not None:
        yield _hash_rows([(*key, running.hexdigest())])


def _hash_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 4
    kinds = [pa.int64()] * 3 + [pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, kinds)], names=[*_KEY, "ids_sha256"])


def id_lists_sha256(ended: DataFrame) -> DataFrame:
    """``depth, a, b, ids_sha256``: SHA-256 of the ascending decimal ids that end at a prefix, joined by commas.

    Ids are cut by ranges, so those of one prefix spread over tasks; each range sends lists, and one task runs the
    hash over a prefix's lists in order."""
    parts = int(ended.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [*_KEY, "conv_id"]
    ranged = ended.select(*order).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    lists = ranged.mapInArrow(_lists, "depth long, a long, b long, first long, ids string")
    return lists.repartition(parts, *_KEY).sortWithinPartitions(*_KEY, "first").mapInArrow(
        _hash_lists, "depth long, a long, b long, ids_sha256 string"
    )


def conversation_trie(convs: DataFrame, placed: DataFrame, batches: int = BATCHES) -> DataFrame:
    """Every prefix of the conversations as ``trie_statistics`` gives it, with ``ends_sha256``, the hash of the ids of the
    conversations that end there (of the empty string, if none).

    ``convs`` holds every ``conv_id`` once, ``placed`` their turns (``turns``); a conversation without turns ends at
    the root.  Equal conversations are inserted once and counted as often as they occur.  Empty tables give no rows.
    """
    rows = stored(prefixes(placed), "prefixes")
    ended = stored(paths(convs, rows), "paths")
    strings = stored(ended.groupBy(*_KEY).agg(F.min("conv_id").alias("conv_id")).select("conv_id", *_KEY), "strings")
    kept = stored(rows.join(strings.select("conv_id"), "conv_id", "left_semi"), "rows")
    nodes = build(strings, kept, batches)
    out = trie_statistics(nodes, kept, ended)
    empty = F.sha2(F.lit("").cast("binary"), 256)
    return out.join(id_lists_sha256(ended), _KEY, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved", F.coalesce("ids_sha256", empty).alias("ends_sha256")
    )
