"""The prefix trie of conversations: one node per distinct beginning, with members, leaves and the tokens that sharing saves.

Turns are dictionary-encoded, so a conversation is a row of 8-byte ids. The distinct id sequences are ordered and dealt out in
ranges of bounded size; each range (a shard) is built as a ternary search tree, its sequences inserted medians first, so that the
tree is balanced. Only nodes on the first or last path of a shard can also lie in another one: these are merged by their path,
which needs nothing but the length that neighbouring shards have in common.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footfall.llm.common import bound_batches, stored

#: Turns (and ends) of one shard, and range of conversation ids whose members are put in one row.
SHARD_TURNS, MEMBERS = 100_000, 1024
#: What counts as a word (fixed value of the contract).
WORD = r"[^\x20\x09-\x0D]+"
EMPTY = hashlib.sha256(b"").hexdigest()
NODE = ("shard long, key string, parent_key string, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, "
        "n_leaves long, saved_tokens long, ends_sha256 string")
RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def encoded(turns: DataFrame, conv_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text") -> DataFrame:
    """(conv_id, ids, words) of every conversation: dictionary ids of its turns, in order, and the words of each.

    Turns are ordered by number, null first; among equal numbers by the SHA-256 of role and text, so the result does not depend
    on the order of rows. Null roles and texts are empty. Rows without a conversation id belong to no conversation.
    """
    role, text = F.coalesce(F.col(role_column), F.lit("")), F.coalesce(F.col(text_column), F.lit(""))
    # the length of the role keeps (role, text) apart from any other split of the same characters
    code = F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256))
    coded = stored(turns.filter(F.col(conv_column).isNotNull()).select(
        F.col(conv_column).cast("long").alias("conv_id"), F.col(turn_column).cast("long").alias("turn"), code.alias("code"),
        F.regexp_count(text, F.lit(WORD)).alias("words")), "coded_turns")
    # ids rise with the codes: ranges in order, sorted inside
    entries = coded.groupBy("code").agg(F.max("words").alias("words")).repartitionByRange("code").sortWithinPartitions("code")
    dictionary = stored(entries.select("code", "words", F.monotonically_increasing_id().alias("id")), "turn_dictionary")
    # both sides are plain tables: a turn that very many conversations share is a partition that adaptive execution splits
    known = coded.select("conv_id", "turn", "code").join(dictionary, "code")
    turn = F.struct(F.col("turn").isNotNull().alias("numbered"), "turn", "id", F.col("words").cast("long").alias("words"))
    return known.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns")).select(
        "conv_id", F.col("turns.id").alias("ids"), F.col("turns.words").alias("words"))


def regrown(sequences: DataFrame, span: int = 20, most: int = 3) -> DataFrame:
    """Conversations rebuilt on shared beginnings: the first h turns of conversation ``c - c % span``, then c's own after its first
    h, with h = crc32(c) % (most + 1). A beginning that does not exist is empty, a shorter one is taken whole."""
    c = F.col("conv_id")
    own = sequences.select(c, "ids", "words", (F.crc32(c.cast("string")) % (most + 1)).cast("int").alias("h"), (c - c % span).alias("start"))
    heads = sequences.filter(c % span == 0).select(c.alias("start"), F.slice("ids", 1, most).alias("head_ids"), F.slice("words", 1, most).alias("head_words"))

    def put(name: str) -> Column:
        head = F.coalesce(F.slice(f"head_{name}", F.lit(1), F.col("h")), F.array().cast("array<bigint>"))
        return F.concat(head, F.slice(name, F.col("h") + 1, F.size(name) + 1)).alias(name)

    return own.join(heads, "start", "left").select("conv_id", put("ids"), put("words"))


# --- distinct sequences and who ends there


def _streamed_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(seq, ends_sha256) from (seq, names) in order, a row at a time: a digest is all that is held of a sequence."""
    current, digest = None, None
    for batch in batches:
        done = []
        for seq, names in zip(batch.column("seq").to_pylist(), batch.column("names").to_pylist(), strict=True):
            if seq != current:
                if current is not None:
                    done.append((current, digest.hexdigest()))
                current, digest = seq, hashlib.sha256(names.encode())
            else:
                digest.update(b"," + names.encode())
        yield pa.RecordBatch.from_pydict({"seq": pa.array([d[0] for d in done], pa.string()), "ends_sha256": pa.array([d[1] for d in done], pa.string())})
    if current is not None:
        yield pa.RecordBatch.from_pydict({"seq": [current], "ends_sha256": [digest.hexdigest()]})


def distinct_sequences(sequences: DataFrame) -> DataFrame:
    """(ids, words, n, least, ends_sha256): every distinct sequence with the number of its members, the least of them and the hash
    of all their names.

    Members are first gathered by ranges of ids of bounded size; a sequence with more ranges than one is hashed range by range.
    """
    seq = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256)
    names = F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",")
    ranges = stored(sequences.select("*", seq.alias("seq"), F.floor(F.col("conv_id") / MEMBERS).alias("range")).groupBy("seq", "range").agg(
        F.first("ids").alias("ids"), F.first("words").alias("words"), F.count("*").alias("n"), F.min("conv_id").alias("least"), names.alias("names")), "members")
    whole = ranges.groupBy("seq").agg(
        F.count("*").alias("ranges"), F.first("ids").alias("ids"), F.first("words").alias("words"), F.sum("n").alias("n"), F.min("least").alias("least"),
        F.first(F.sha2("names", 256)).alias("only"))
    whole = stored(whole, "distinct_sequences")
    several = ranges.join(whole.filter("ranges > 1").select("seq"), "seq", "left_semi").select("seq", "range", "names")
    digests = several.repartition("seq").sortWithinPartitions("seq", "range").mapInArrow(_streamed_digests, "seq string, ends_sha256 string")
    return whole.join(digests, "seq", "left").select("ids", "words", "n", "least", F.coalesce("ends_sha256", "only").alias("ends_sha256"))


# --- shards


def _cut(limit: int, schema: str):
    """Give every row of a sorted partition its shard: a new one wherever the turns of the present one exceed the limit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, turns = 0, 0
        for batch in batches:
            shards = []
            for part, size in zip(batch.column("shard").to_pylist(), batch.column("ids").value_lengths().to_pylist(), strict=True):
                if turns and turns + size + 1 > limit:
                    block, turns = block + 1, 0
                turns += size + 1
                shards.append((part << 32) + block)
            yield batch.set_column(batch.schema.get_field_index("shard"), "shard", pa.array(shards, pa.int64()))

    return lambda df: df.mapInArrow(run, schema)


def _common(a: Column, b: Column) -> Column:
    """Length of the common beginning of two arrays; -1 if one is missing."""
    size = F.least(F.size(a), F.size(b))
    differs = F.array_position(F.transform(F.sequence(F.lit(1), size), lambda i: F.element_at(a, i) == F.element_at(b, i)), False)
    return F.when(a.isNull() | b.isNull(), -1).when(size == 0, 0).when(differs == 0, size).otherwise(differs - 1).cast("int")


def _neighbours(shards: DataFrame) -> DataFrame:
    """(shard, before, after): turns that the shard's first sequence has in common with the one before it, and its last with the one after."""
    ends = stored(shards.groupBy("shard").agg(F.min("ids").alias("first"), F.max("ids").alias("last")), "shard_ends")
    # one row a shard, without its sequences
    place = ends.select("shard", F.row_number().over(Window.orderBy("shard")).alias("place"))
    placed = stored(ends.join(place, "shard"), "placed_shards")
    prior = placed.select((F.col("place") + 1).alias("place"), F.col("last").alias("prior"))
    following = placed.select((F.col("place") - 1).alias("place"), F.col("first").alias("following"))
    return placed.join(prior, "place", "left").join(following, "place", "left").select(
        "shard", _common(F.col("prior"), F.col("first")).alias("before"), _common(F.col("last"), F.col("following")).alias("after"))


class TernaryTree:
    """A ternary search tree over turn ids as parallel lists; node 0 is the root, and every other node is one beginning."""

    def __init__(self):
        self.symbol, self.low, self.equal, self.high, self.up = [-1], [-1], [-1], [-1], [-1]
        self.depth, self.words, self.members, self.least, self.ends = [0], [0], [0], [None], [None]

    def _new(self, symbol: int, up: int, words: int) -> int:
        for column, value in ((self.symbol, symbol), (self.low, -1), (self.equal, -1), (self.high, -1), (self.up, up), (self.depth, self.depth[up] + 1),
                              (self.words, words), (self.members, 0), (self.least, None), (self.ends, None)):
            column.append(value)
        return len(self.symbol) - 1

    def _child(self, node: int, symbol: int, words: int) -> int:
        at = self.equal[node]
        if at < 0:
            self.equal[node] = self._new(symbol, node, words)
            return self.equal[node]
        while self.symbol[at] != symbol:
            side = self.low if symbol < self.symbol[at] else self.high
            if side[at] < 0:
                side[at] = self._new(symbol, node, words)
            at = side[at]
        return at

    def insert(self, ids: list[int], words: list[int], n: int, least: int, ends: str) -> list[int]:
        """Add a sequence with its ``n`` members; returns its path of nodes."""
        path = [0]
        for symbol, count in zip(ids, words, strict=True):
            path.append(self._child(path[-1], symbol, count))
        for node in path:
            self.members[node] += n
            self.least[node] = least if self.least[node] is None else min(self.least[node], least)
        self.ends[path[-1]] = ends
        return path

    def totals(self, continued: set[int], extended: set[int]) -> tuple[list[int], list[int], list[int]]:
        """(children, leaves, saved tokens) of every node, over its whole subtree here.

        Nodes come after their parents in the lists, so one walk from the end gathers subtrees without recursion. A node
        ``continued`` from an earlier shard has been counted there, as its parent's child and as the copy that is not saved; a
        node ``extended`` in a later shard is no leaf.
        """
        size = len(self.symbol)
        children, leaves, saved = [0] * size, [0] * size, [0] * size
        for node in range(size - 1, -1, -1):
            saved[node] += (self.members[node] - (node not in continued)) * self.words[node]
            if not children[node] and self.equal[node] < 0 and node not in extended:
                leaves[node] = 1
            up = self.up[node]
            if up >= 0:
                children[up] += node not in continued
                leaves[up] += leaves[node]
                saved[up] += saved[node]
        return children, leaves, saved


def _medians_first(size: int) -> Iterator[int]:
    waiting = [(0, size)]
    while waiting:
        low, high = waiting.pop()
        if low < high:
            middle = (low + high) // 2
            yield middle
            waiting += [(middle + 1, high), (low, middle)]


def _keys(ids: list[int], depth: int) -> list[str]:
    """Names of the nodes of a path down to a depth."""
    state, found = hashlib.sha256(), []
    for d in range(depth + 1):
        found.append(state.hexdigest())
        if d < depth:
            state.update(b"%d," % ids[d])
    return found


def _shard_nodes(rows: pd.DataFrame) -> pd.DataFrame:
    """All nodes of a shard; those that other shards hold too have a key and are partial."""
    sequences = sorted(([int(i) for i in ids], [int(w) for w in words], int(n), int(least), ends)
                       for ids, words, n, least, ends in zip(rows["ids"], rows["words"], rows["n"], rows["least"], rows["ends_sha256"], strict=True))
    before, after = int(rows["before"].iloc[0]), int(rows["after"].iloc[0])
    tree = TernaryTree()
    paths = {}
    for i in _medians_first(len(sequences)):
        path = tree.insert(*sequences[i])
        if i in (0, len(sequences) - 1):
            paths[i] = path
    first, last = paths[0], paths[len(sequences) - 1]
    keys = dict(zip(first[: before + 1], _keys(sequences[0][0], before), strict=True)) if before >= 0 else {}
    keys |= dict(zip(last[: after + 1], _keys(sequences[-1][0], after), strict=True)) if after >= 0 else {}
    children, leaves, saved = tree.totals(set(first[: before + 1]), {last[-1]} if after == len(last) - 1 else set())
    up = tree.up
    return pd.DataFrame({
        "shard": int(rows["shard"].iloc[0]), "key": [keys.get(i) for i in range(len(up))], "parent_key": [keys.get(u) for u in up],
        "conv_id": tree.least, "depth": tree.depth,
        "parent_conv_id": pd.array([None if u < 0 or u in keys else tree.least[u] for u in up], dtype="Int64"),
        "n_convs": tree.members, "n_children": children, "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": tree.ends})


def prefix_nodes(sequences: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row per node of the trie of (conv_id, ids, words): conv_id (least member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256.

    An empty table has no members and so no node, not even a root. Equal conversations are members of the same nodes; a
    conversation without turns is a member of the root alone.
    """
    bound_batches(sequences.sparkSession)
    distinct = stored(distinct_sequences(sequences), "sequences")
    turns = distinct.agg(F.sum(F.size("ids") + 1).alias("turns")).first()["turns"] or 0
    schema = "shard long, ids array<long>, words array<long>, n long, least long, ends_sha256 string"
    ranged = distinct.repartitionByRange(max(1, -(-turns // shard_turns)), "ids").sortWithinPartitions("ids")
    ranged = ranged.select(F.spark_partition_id().cast("long").alias("shard"), "ids", "words", "n", "least", "ends_sha256")
    shards = stored(_cut(shard_turns, schema)(ranged), "shards")
    nodes = stored(shards.join(_neighbours(shards), "shard").groupBy("shard").applyInPandas(_shard_nodes, NODE), "shard_nodes")

    merged = stored(nodes.filter("key IS NOT NULL").groupBy("key").agg(
        F.max("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")], F.max("ends_sha256").alias("ends_sha256")), "merged_nodes")
    least = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("found"))
    # what hangs from a merged node looks it up by shard: the children of the root are as many as the beginnings
    by_shard = nodes.filter("key IS NOT NULL").select("shard", F.col("key").alias("parent_key")).join(least, "parent_key")
    inner = nodes.filter("key IS NULL").join(by_shard, ["shard", "parent_key"], "left")
    outer = merged.join(least, "parent_key", "left").withColumn("parent_conv_id", F.lit(None).cast("long"))
    found = inner.drop("shard", "key").unionByName(outer.drop("key"))
    found = found.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "found")).withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY)))
    return found.select(*RESULT)
