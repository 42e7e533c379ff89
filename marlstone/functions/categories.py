"""Key categories: ordered prefix rules, first match wins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Prefixes of lower-case hex keys and their categories, in matching order.
OP_RULES = (
    ("7365637572652d6b65792d", "PreimagePrefix"), ("657468657265756d2d636f6e6669672d", "ConfigPrefix"), ("657468657265756d2d67656e657369732d", "GenesisPrefix"),
    ("636874526f6f7456322d", "ChtPrefix"), ("636874496e64657856322d", "ChtIndexTablePrefix"), ("6669786564526f6f742d", "FixedCommitteeRootKey"),
    ("636f6d6d69747465652d", "SyncCommitteeKey"), ("6368742d", "ChtTablePrefix"), ("626c74526f6f742d", "BloomTriePrefix"), ("626c74496e6465782d", "BloomTrieIndexPrefix"),
    ("626c742d", "BloomTrieTablePrefix"), ("636c697175652d", "CliqueSnapshotPrefix"), ("7570646174652d", "BestUpdateKey"), ("536e617073686f7453796e63537461747573", "SnapshotSyncStatusKey"),
    ("536e617073686f7444697361626c6564", "SnapshotDisabledKey"), ("536e617073686f74526f6f74", "SnapshotRootKey"), ("536e617073686f744a6f75726e616c", "SnapshotJournalKey"),
    ("536e617073686f7447656e657261746f72", "SnapshotGeneratorKey"), ("536e617073686f745265636f76657279", "SnapshotRecoveryKey"), ("536b656c65746f6e53796e63537461747573", "SkeletonSyncStatusKey"),
    ("5472696553796e63", "FastTrieProgressKey"), ("547269654a6f75726e616c", "TrieJournalKey"), ("5472616e73616374696f6e496e6465785461696c", "TxIndexTailKey"),
    ("466173745472616e73616374696f6e4c6f6f6b75704c696d6974", "FastTxLookupLimitKey"), ("496e76616c6964426c6f636b", "BadBlockKey"), ("756e636c65616e2d73687574646f776e", "UncleanShutdownKey"),
    ("657468322d7472616e736974696f6e", "TransitionStatusKey"), ("536e617053796e63537461747573", "SnapSyncStatusFlagKey"), ("446174616261736556657273696f6e", "DatabaseVersionKey"),
    ("4c617374486561646572", "HeadHeaderKey"), ("4c617374426c6f636b", "HeadBlockKey"), ("4c61737446617374", "HeadFastBlockKey"), ("4c61737446696e616c697a6564", "HeadFinalizedBlockKey"),
    ("4c61737453746174654944", "PersistentStateIDKey"), ("4c6173745069766f74", "LastPivotKey"), ("69", "BloomBitsIndexPrefix"), ("68", "HeaderPrefix"), ("74", "HeaderTDSuffix"),
    ("6e", "HeaderHashSuffix"), ("48", "HeaderNumberPrefix"), ("62", "BlockBodyPrefix"), ("72", "BlockReceiptsPrefix"), ("6c", "TxLookupPrefix"), ("42", "BloomBitsPrefix"),
    ("61", "SnapshotAccountPrefix"), ("6f", "SnapshotStoragePrefix"), ("63", "CodePrefix"), ("53", "SkeletonHeaderPrefix"), ("41", "TrieNodeAccountPrefix"), ("4f", "TrieNodeStoragePrefix"),
    ("4c", "StateIDPrefix"), ("76", "VerklePrefix"),
)
# The order in which stored keys are matched; there BloomBitsIndexPrefix is 6942.
STORAGE_ORDER = (
    "DatabaseVersionKey", "HeadHeaderKey", "HeadBlockKey", "HeadFastBlockKey", "HeadFinalizedBlockKey", "PersistentStateIDKey", "LastPivotKey", "FastTrieProgressKey", "SnapshotDisabledKey",
    "SnapshotRootKey", "SnapshotJournalKey", "SnapshotGeneratorKey", "SnapshotRecoveryKey", "SnapshotSyncStatusKey", "SkeletonSyncStatusKey", "TrieJournalKey", "TxIndexTailKey",
    "FastTxLookupLimitKey", "BadBlockKey", "UncleanShutdownKey", "TransitionStatusKey", "SnapSyncStatusFlagKey", "HeaderPrefix", "HeaderTDSuffix", "HeaderHashSuffix", "HeaderNumberPrefix",
    "BlockBodyPrefix", "BlockReceiptsPrefix", "TxLookupPrefix", "BloomBitsPrefix", "SnapshotAccountPrefix", "SnapshotStoragePrefix", "CodePrefix", "SkeletonHeaderPrefix",
    "TrieNodeAccountPrefix", "TrieNodeStoragePrefix", "StateIDPrefix", "VerklePrefix", "PreimagePrefix", "ConfigPrefix", "GenesisPrefix", "BloomBitsIndexPrefix", "ChtPrefix",
    "ChtTablePrefix", "ChtIndexTablePrefix", "BloomTriePrefix", "BloomTrieTablePrefix", "BloomTrieIndexPrefix", "CliqueSnapshotPrefix", "BestUpdateKey", "FixedCommitteeRootKey", "SyncCommitteeKey",
)
STORAGE_RULES = tuple(({c: p for p, c in OP_RULES} | {"BloomBitsIndexPrefix": "6942"})[c] for c in STORAGE_ORDER)
# Operations that have a distribution, and its name.
BUCKETS = {"Get": "get", "Put": "put", "BatchPut": "batchput", "BatchDelete": "delete", "NewIterator": "scan"}


def first_match(key: Column, rules, missing: Column) -> Column:
    """The name of the first rule whose prefix the key starts with."""
    return reduce(lambda rest, rule: F.when(key.startswith(rule[0]), F.lit(rule[1])).otherwise(rest), reversed(list(rules)), missing)


def category(key: Column) -> Column:
    """Category of a hex key of an operation: noPrefix without a key, Unknown without a rule."""
    return F.when(F.coalesce(key, F.lit("")) == "", F.lit("noPrefix")).otherwise(first_match(key, OP_RULES, F.lit("Unknown")))


def storage_prefix(key: Column) -> Column:
    """The hex prefix under which a stored key (hex) is reported, noPrefix without one."""
    return first_match(key, [(p, p) for p in STORAGE_RULES], F.lit("noPrefix"))


def bucket(op_type: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in BUCKETS.items() for x in pair]), op_type)


def pretty_size(n: Column) -> Column:
    """Bytes as B, KiB, MiB, GiB or TiB; a unit is used above one of it, not at one."""
    out = F.format_string("%.2f B", n.cast("double"))
    for i, unit in enumerate(("KiB", "MiB", "GiB", "TiB"), 1):
        out = F.when(n > 1024**i, F.format_string(f"%.2f {unit}", n / 1024**i)).otherwise(out)
    return out
