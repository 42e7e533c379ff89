"""Sizes and counts of a key-value store by strict key class: prefix and exact length, suffix, whole key or hash of the value."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.categories import OP_RULES
from marlstone.functions.codecs import keccak

# The classes that a report lists, in its order.
STORE = (
    "Headers", "Bodies", "Receipt lists", "Difficulties", "Block number->hash", "Block hash->number", "Transaction index", "Bloombit index", "Contract codes", "Hash trie nodes",
    "Path trie state lookups", "Path trie account nodes", "Path trie storage nodes", "Verkle trie nodes", "Verkle trie state lookups", "Trie preimages", "Account snapshot",
    "Storage snapshot", "Beacon sync headers", "Clique snapshots", "Singleton metadata",
)
LIGHT = ("CHT trie nodes", "Bloom trie nodes")
# Names of single entries.
SINGLE = (
    "DatabaseVersionKey", "HeadHeaderKey", "HeadBlockKey", "HeadFastBlockKey", "HeadFinalizedBlockKey", "LastPivotKey", "FastTrieProgressKey", "SnapshotDisabledKey", "SnapshotRootKey",
    "SnapshotJournalKey", "SnapshotGeneratorKey", "SnapshotRecoveryKey", "TxIndexTailKey", "FastTxLookupLimitKey", "UncleanShutdownKey", "BadBlockKey", "TransitionStatusKey",
    "SkeletonSyncStatusKey", "PersistentStateIDKey", "TrieJournalKey", "SnapshotSyncStatusKey", "SnapSyncStatusFlagKey",
)
PREFIX = {name: prefix for prefix, name in OP_RULES} | {"BloomBitsIndexPrefix": "6942"}
HASH = 64  # hex digits of a hash


def account_node(key: Column) -> Column:
    """A path of up to 63 nibbles after its prefix."""
    return key.startswith(PREFIX["TrieNodeAccountPrefix"]) & (F.length(key) < 2 + 2 * HASH)


def storage_node(key: Column) -> Column:
    """A hash and a path of up to 63 nibbles after the prefix."""
    return key.startswith(PREFIX["TrieNodeStoragePrefix"]) & F.length(key).between(2 + HASH, 2 + 3 * HASH - 1)


def strict_class(key: Column, is_hash: Column) -> Column:
    """The class of a key in lower-case hex; is_hash says whether it is the Keccak hash of its value. First match wins."""

    def fixed(name: str, digits: int) -> Column:
        return key.startswith(PREFIX[name]) & (F.length(key) == len(PREFIX[name]) + digits)

    def any_of(*names: str) -> Column:
        return reduce(lambda a, b: a | b, (key.startswith(PREFIX[n]) for n in names))

    # Verkle data is told apart by what follows its prefix
    rest = F.substr(key, F.lit(len(PREFIX["VerklePrefix"]) + 1))
    state = PREFIX["StateIDPrefix"]
    meta = rest.isin(PREFIX["PersistentStateIDKey"], PREFIX["TrieJournalKey"], PREFIX["SnapSyncStatusFlagKey"])
    verkle = F.when(account_node(rest), "Verkle trie nodes").when(rest.startswith(state) & (F.length(rest) == len(state) + HASH), "Verkle trie state lookups").when(meta, "Singleton metadata").otherwise("unaccounted")
    header = key.startswith(PREFIX["HeaderPrefix"])
    rules = (
        (fixed("HeaderPrefix", 16 + HASH), "Headers"),
        (fixed("BlockBodyPrefix", 16 + HASH), "Bodies"),
        (fixed("BlockReceiptsPrefix", 16 + HASH), "Receipt lists"),
        (header & key.endswith(PREFIX["HeaderTDSuffix"]), "Difficulties"),
        (header & key.endswith(PREFIX["HeaderHashSuffix"]), "Block number->hash"),
        (fixed("HeaderNumberPrefix", HASH), "Block hash->number"),
        (is_hash, "Hash trie nodes"),
        (fixed("StateIDPrefix", HASH), "Path trie state lookups"),
        (account_node(key), "Path trie account nodes"),
        (storage_node(key), "Path trie storage nodes"),
        (fixed("CodePrefix", HASH), "Contract codes"),
        (fixed("TxLookupPrefix", HASH), "Transaction index"),
        (fixed("SnapshotAccountPrefix", HASH), "Account snapshot"),
        (fixed("SnapshotStoragePrefix", 2 * HASH), "Storage snapshot"),
        (fixed("PreimagePrefix", HASH), "Trie preimages"),
        (fixed("ConfigPrefix", HASH) | fixed("GenesisPrefix", HASH), "Singleton metadata"),
        (fixed("BloomBitsPrefix", 20 + HASH) | key.startswith(PREFIX["BloomBitsIndexPrefix"]), "Bloombit index"),
        (fixed("SkeletonHeaderPrefix", 16), "Beacon sync headers"),
        (key.startswith(PREFIX["CliqueSnapshotPrefix"]) & (F.length(key) == 14 + HASH), "Clique snapshots"),
        (any_of("ChtTablePrefix", "ChtIndexTablePrefix", "ChtPrefix"), "CHT trie nodes"),
        (any_of("BloomTrieTablePrefix", "BloomTrieIndexPrefix", "BloomTriePrefix"), "Bloom trie nodes"),
        (key.startswith(PREFIX["VerklePrefix"]), verkle),
        (key.isin(*[PREFIX[n] for n in SINGLE]), "Singleton metadata"),
    )
    return reduce(lambda other, rule: F.when(rule[0], rule[1]).otherwise(other), reversed(rules), F.lit("unaccounted"))


def inspect(kv: DataFrame, ancients: DataFrame | None = None) -> DataFrame:
    """(store, kind, n, bytes): a row for each class, used or not, then `unaccounted` and, over all stores, `Total`.

    kv: key and value, binary. ancients: (kind, n, bytes) of the tables of an
    append-only store. Only values under keys of 32 bytes are hashed.
    """
    sized = kv.select("key", "value", F.lower(F.hex("key")).alias("k"), (F.octet_length("key") + F.octet_length("value")).cast("long").alias("b"))
    other = sized.where(F.octet_length("key") != 32).select(strict_class(F.col("k"), F.lit(False)).alias("kind"), "b")
    hashed = sized.where(F.octet_length("key") == 32).withColumn("h", keccak("value")).select(strict_class(F.col("k"), F.col("h").eqNullSafe(F.col("key"))).alias("kind"), "b")
    found = other.unionByName(hashed).groupBy("kind").agg(F.count("*").alias("n"), F.sum("b").alias("bytes"))
    listed = [("Key-Value store", k) for k in STORE] + [("Light client", k) for k in LIGHT] + [("", "unaccounted")]
    rows = kv.sparkSession.createDataFrame(listed, "store string, kind string").join(found, "kind", "left").select("store", "kind", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n", "bytes")])
    if ancients is not None:
        rows = rows.unionByName(ancients.select(F.lit("Ancient store").alias("store"), "kind", "n", "bytes"))
    return rows.unionByName(rows.agg(F.lit("").alias("store"), F.lit("Total").alias("kind"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes")))
