"""Prefix trie of conversations by collapsing whole sequences.

1. Every conversation becomes a chain of keys: the key of its first d turns is the hash of the key
   before and of turn d, so texts stay behind and equal prefixes have equal keys.
2. Conversations that are equal as wholes collapse into one weighted sequence, named by its smallest
   conversation. The conversations that end in a sequence form its end list.
3. A sequence whose key is a proper prefix of another one is no leaf: an anti-join against the keys of proper
   prefixes leaves the leaves.
4. Weighted sequences spread over their prefixes; aggregates by key give the nodes. A node belongs to the
   sequence of its smallest conversation, and a sequence owns the tail of its path, so sums over a subtree
   are sums over the sequences that pass through it: each adds what it owns from there on. No step
   goes level by level and nothing is added up over pairs of nodes.

The keys are 128 bits of BLAKE2b over length-prefixed roles and texts. Rows without a conversation id
belong to no conversation and are left out. Null roles and texts are empty; turns are ordered by turn (null first),
then role and text, so rows that agree in all are interchangeable. An empty table has no nodes. Columns other than
conv_id, turn, role and text are ignored. Keys met by more than 1/1024 of all rows join by broadcast (fewer than 1024
rows), all others by a shuffle. A conversation is one row while its keys are made, as its turns follow on each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidepanel.llm.common import many_to_one, materialize

CHUNK_BITS = 12
_TURN = "struct<role:string,text:string>"


def turns_by_conversation(conversations: DataFrame, group: Column | None = None) -> DataFrame:
    """conv_id, turns (role, text in order), and ``family`` to partition by if a group is given."""
    empty = lambda name: F.coalesce(F.col(name), F.lit("")).alias(name)
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"), (F.col("conv_id") if group is None else group).cast("bigint").alias("family"),
        F.struct("turn", empty("role"), empty("text")).alias("t"),
    )
    gathered = rows.repartition("family").groupBy("family", "conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    return gathered.select("family", "conv_id", F.transform("ts", lambda t: F.struct(t["role"], t["text"])).cast(f"array<{_TURN}>").alias("turns"))


def share_openings(conversations: DataFrame, family: int = 20, most: int = 3) -> DataFrame:
    """Conversations rebuilt on the opening of the first one of their family: conv_id, turns.

    The opening has h turns, h = crc32 of the decimal id modulo ``most`` + 1, or all the first one has. One shuffle.
    """
    first = F.col("conv_id") - F.col("conv_id") % family
    own = turns_by_conversation(conversations, first)
    opening = F.max(F.when(F.col("conv_id") == F.col("family"), F.slice("turns", 1, most))).over(Window.partitionBy("family"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)).cast("int")
    return own.select("conv_id", "turns", opening.alias("opening"), h.alias("h")).select(
        "conv_id",
        F.concat(
            F.slice(F.coalesce("opening", F.array().cast(f"array<{_TURN}>")), F.lit(1), F.col("h")),
            F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0))),
        ).alias("turns"),
    )


def _framed(text: str) -> bytes:
    raw = text.encode("utf-8", "surrogatepass")
    return len(raw).to_bytes(8, "little") + raw


_CHAINS = "conv_id bigint, keys array<binary>, words array<bigint>"


def chains(sequences: DataFrame) -> DataFrame:
    """conv_id, keys of its prefixes (the root's first) and the words of the last turn of each."""
    root = hashlib.blake2b(b"", digest_size=16).digest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, words = [], []
            for turns in batch["turns"]:
                path, counts = [root], [0]
                for turn in turns:
                    role, text = turn["role"].as_py(), turn["text"].as_py()
                    path.append(hashlib.blake2b(path[-1] + _framed(role) + _framed(text), digest_size=16).digest())
                    counts.append(len(text.encode("utf-8", "surrogatepass").split()))
                keys.append(path)
                words.append(counts)
            yield pa.RecordBatch.from_arrays(
                [batch["conv_id"], pa.array(keys, pa.list_(pa.binary())), pa.array(words, pa.list_(pa.int64()))],
                names=["conv_id", "keys", "words"],
            )

    return sequences.select("conv_id", "turns").mapInArrow(run, _CHAINS)


def end_lists(ends: DataFrame) -> DataFrame:
    """key, ends_sha256: SHA-256 of the ascending ids of each key, comma-joined.

    Ids are first gathered in ranges of 4096, so a key held by a third of all conversations is gathered by many
    tasks; its last step streams those ranges in order through one hash, which cannot be split.
    """
    ranges = (
        ends.groupBy("key", F.shiftright("conv_id", CHUNK_BITS).alias("range"))
        .agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
        .select("key", "range", F.concat_ws(",", F.col("ids").cast("array<string>")).alias("ids"))
    )

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None
        for batch in batches:
            done: list[tuple[bytes, str]] = []
            for k, ids in zip(batch["key"].to_pylist(), batch["ids"].to_pylist(), strict=True):
                if k != key:
                    if digest is not None:
                        done.append((key, digest.hexdigest()))
                    key, digest = k, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield _digests(done)
        if digest is not None:
            yield _digests([(key, digest.hexdigest())])

    return ranges.repartition("key").sortWithinPartitions("key", "range").mapInArrow(stream, "key binary, ends_sha256 string")


def _digests(rows: list[tuple[bytes, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())], names=["key", "ends_sha256"]
    )


def weighted_sequences(paths: DataFrame) -> DataFrame:
    """Distinct whole sequences: owner (smallest conversation), weight, keys, words, is_leaf."""
    whole = F.element_at("keys", -1)
    groups = paths.groupBy(whole.alias("whole")).agg(F.min("conv_id").alias("owner"), F.count("*").alias("weight"))
    distinct = materialize(
        groups.join(paths.withColumnRenamed("conv_id", "owner"), "owner").select("owner", "whole", "weight", "keys", "words"), "sequences"
    )
    proper = distinct.select(F.explode(F.slice("keys", F.lit(1), F.size("keys") - 1)).alias("whole")).distinct()
    leaves = distinct.join(proper, "whole", "left_anti").select("owner", F.lit(1).alias("leaf"))
    return distinct.join(leaves, "owner", "left").select(
        "owner", "weight", "keys", "words", F.coalesce("leaf", F.lit(0)).cast("bigint").alias("is_leaf")
    )


def prefix_trie(sequences: DataFrame) -> DataFrame:
    """Nodes of the trie over rows (conv_id, turns), conv_id being unique.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (tokens that a cache of
    prefixes need not compute again, over the subtree), ends_sha256.
    """
    paths = materialize(chains(sequences), "chains")
    weighted = weighted_sequences(paths)
    steps = materialize(
        weighted.select("owner", "weight", "is_leaf", F.posexplode(F.arrays_zip("keys", "words")).alias("depth", "step")).select(
            "owner", "weight", "is_leaf", "depth", F.col("step.keys").alias("key"), F.col("step.words").alias("words")
        ),
        "steps",
    )
    nodes = steps.groupBy("key").agg(F.sum("weight").alias("n_convs"), F.min("owner").alias("node"))
    placed = many_to_one(steps, materialize(nodes, "nodes"), ["key"])
    down = Window.partitionBy("owner").orderBy(F.col("depth").desc())
    owned = F.col("node") == F.col("owner")
    along = placed.select(
        "key", "depth", "node", "owner", "n_convs", "is_leaf", owned.alias("owned"), F.lead("node").over(down).alias("above"),
        F.lag(owned, 1, False).over(down).cast("bigint").alias("opens"),
        F.sum(F.when(owned, (F.col("n_convs") - 1) * F.col("words")).otherwise(0)).over(down.rowsBetween(Window.unboundedPreceding, 0)).alias("saved"),
    )
    totals = along.groupBy("key").agg(
        F.min("owner").alias("conv_id"), F.max("depth").cast("bigint").alias("depth"), F.max(F.when(F.col("owned"), F.col("above"))).alias("parent_conv_id"),
        F.max("n_convs").alias("n_convs"), F.sum("opens").alias("n_children"), F.sum("is_leaf").alias("n_leaves"),
        F.sum("saved").alias("saved_tokens"),
    )
    ends = end_lists(paths.select(F.element_at("keys", -1).alias("key"), "conv_id"))
    return totals.join(ends, "key", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
