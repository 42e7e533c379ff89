"""Queries of block batches, tags, fees, inspection, pools, nodes, tracers and streams, beside their DuckDB SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from marlstone.functions import codecs
from marlstone.functions.checkpoints import work_folder
from marlstone.operators import access as a
from marlstone.operators import batches as b
from marlstone.operators import chain as c
from marlstone.operators import fees, inspection, plugins, pool, queues
from marlstone.plans import adapters as ad
from marlstone.plans.adapters import KV, LOGS, TRACE, TXS
from marlstone.plans.catalog import LOG_COLUMNS, SQL, categorised, query
from marlstone.streaming import streams

# --- block batches, tags and stores
RANGES = ((0, 3), (4, 7), (8, 11), (12, 12), (15, 20), (21, 24), (25, 28), (29, 400))
RANGE_SQL = "ranges AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {x}, {y})" for i, (x, y) in enumerate(RANGES)) + ") t(batch, lo, hi))"
IN_RANGE = f"""{TRACE}, {RANGE_SQL}, whole AS (SELECT r.* FROM ranges r WHERE lo IN (SELECT block_id FROM trace) AND hi IN (SELECT block_id FROM trace)),
t AS (SELECT trace.* EXCLUDE (batch), CAST(whole.batch AS BIGINT) AS batch FROM trace JOIN whole ON block_id BETWEEN lo AND hi)"""


def in_ranges(s, d):
    return b.in_batches(ad.trace(s, d), b.batch_table(s, RANGES))


@query(f"WITH {IN_RANGE} SELECT batch, category, op_type, count(*) AS n FROM t GROUP BY ALL")
def op_count_by_block_batch(s, d):
    return a.op_counts(in_ranges(s, d), "batch")


@query(f"""WITH {IN_RANGE}, p AS (SELECT batch, block_id, key, lag(key) OVER (PARTITION BY block_id ORDER BY seq) AS o FROM t WHERE op_type = 'Get')
SELECT batch, least(key, o) AS k1, greatest(key, o) AS k2, count(*) AS freq, array_to_string(list_sort(list(DISTINCT block_id)), ';') AS blocks FROM p WHERE o IS NOT NULL GROUP BY ALL HAVING count(*) > 1""")
def pairs_by_block_batch(s, d):
    rows = in_ranges(s, d).where("op_type = 'Get'").select("segment_id", "block_id", "batch", "seq", "key")
    return a.pair_counts(a.neighbours(rows, (0,)), ["batch"]).select("batch", "k1", "k2", "freq", ad.joined(F.col("blocks")).alias("blocks"))


@query(f"""WITH {TRACE}, p AS (SELECT block_id, key, lag(key) OVER (PARTITION BY block_id ORDER BY seq) AS o FROM trace WHERE op_type = 'Get')
SELECT least(key, o) AS k1, greatest(key, o) AS k2, count(*) AS freq, count(DISTINCT block_id) AS n_blocks FROM p WHERE o IS NOT NULL GROUP BY ALL HAVING count(*) > 1""")
def pair_totals(s, d):
    rows = ad.trace(s, d).where("op_type = 'Get'").select("segment_id", "block_id", "seq", "key")
    return a.pair_totals(a.neighbours(rows, (0,)), [])


@query(f"WITH {TRACE} SELECT category, op_type, count(*) AS n FROM trace WHERE block_id >= 20 GROUP BY ALL")
def trace_from_block(s, d):
    return a.op_counts(b.from_block(ad.trace(s, d), 20))


@query(f"WITH {LOGS}, h AS (SELECT max(block_number) AS m FROM logs) SELECT block_number, tx_hash, pos, address, data FROM logs, h WHERE block_number BETWEEN greatest(m - 8, 0) AND greatest(m - 2, 0)")
def log_filter_tags(s, d):
    logs = ad.logs(s, d)
    return b.log_range(logs, b.heads(logs, 2, 8).first().asDict(), "finalized", "safe").select(*LOG_COLUMNS)


@query(f"WITH {TXS}, p AS (SELECT *, row_number() OVER (ORDER BY tx_hash) AS i, sum(strlen(status || reward)) OVER (ORDER BY tx_hash) AS total FROM txs WHERE block_number = 3 AND tx_hash BETWEEN 320 AND 359) SELECT tx_hash, reward FROM p WHERE tx_hash - 320 = i - 1 AND (i = 1 OR total <= 40)")
def store_range(s, d):
    items = ad.txs(s, d).select(F.col("block_number").cast("string").alias("kind"), F.col("tx_hash").alias("number"), F.concat("status", F.col("reward").cast("string")).alias("data"), "reward")
    return b.store_range(items, "3", 320, 40, 40).select(F.col("number").alias("tx_hash"), "reward")


HEADERS = "headers AS (SELECT o_orderkey AS number, o_custkey AS hash, o_orderstatus <> 'P' AS canonical FROM orders)"


def headers(s, d):
    return ad.table(s, d, "orders").select(F.col("o_orderkey").alias("number"), F.col("o_custkey").alias("hash"), (F.col("o_orderstatus") != "P").alias("canonical"))


@query(f"WITH {HEADERS} SELECT number, hash FROM headers WHERE canonical AND number BETWEEN 401 AND 500")
def headers_back(s, d):
    return b.headers_back(headers(s, d), 500, 100).select("number", "hash")


@query(f"WITH {HEADERS} SELECT number, hash FROM headers WHERE number BETWEEN 64 AND 128")
def hashes_in_range(s, d):
    return b.hashes_in_range(headers(s, d), 64, 128)


@query(f"WITH {HEADERS} SELECT number, hash FROM headers WHERE canonical AND number >= 100 AND number < 900 ORDER BY number LIMIT 50")
def canonical_hashes(s, d):
    return b.canonical_hashes(headers(s, d), 100, 900, 50)


@query("SELECT substr(p_name, 7) AS p_name, p_partkey FROM part WHERE p_name LIKE 'small %'")
def prefixed_view(s, d):
    return b.prefixed(ad.table(s, d, "part").select("p_name", "p_partkey"), "p_name", "small ")


# --- fees
BLOCKS = f"""{TXS}, blocks AS (SELECT block_number, 1000000000 + block_number * 7919 % 1000 * 1000000 AS base_fee, 50000 AS gas_limit, CAST(sum(gas_used) AS BIGINT) AS gas_used,
block_number * 131072 * 13 % 40000000 AS excess, block_number % 7 * 131072 AS blob_used FROM txs GROUP BY block_number)"""


def blocks(s, d):
    n = F.col("block_number")
    per = ad.txs(s, d).groupBy("block_number").agg(F.sum("gas_used").alias("gas_used"))
    return per.select("block_number", (n * 7919 % 1000 * 1_000_000 + 1_000_000_000).alias("base_fee"), F.lit(50_000).cast("long").alias("gas_limit"), "gas_used", (n * (131072 * 13) % 40_000_000).alias("excess_blob_gas"), (n % 7 * 131072).alias("blob_gas_used"))


NEXT_BASE = """CASE WHEN gas_used = 25000 THEN base_fee WHEN gas_used > 25000 THEN base_fee + greatest(base_fee::HUGEINT * (gas_used - 25000) // 25000 // 8, 1)
ELSE greatest(base_fee - base_fee::HUGEINT * (25000 - gas_used) // 25000 // 8, 0) END"""


@query(f"WITH {BLOCKS} SELECT block_number, base_fee, CAST({NEXT_BASE} AS BIGINT) AS next_base_fee FROM blocks")
def base_fee_next(s, d):
    x = blocks(s, d)
    return x.select("block_number", "base_fee", fees.next_base_fee(F.col("base_fee"), F.col("gas_used"), F.col("gas_limit")).cast("long").alias("next_base_fee"))


BLOB_SQL = f"""RECURSIVE {BLOCKS}, x AS (SELECT DISTINCT e FROM (SELECT excess AS e FROM blocks UNION ALL SELECT greatest(excess + blob_used - 393216, 0) FROM blocks)),
terms AS (SELECT e, 3338477::HUGEINT AS term, 3338477::HUGEINT AS total, 1 AS i FROM x
UNION ALL SELECT e, term * e // (3338477 * i), total + term * e // (3338477 * i), i + 1 FROM terms WHERE term > 0),
fee AS (SELECT e, max(total) // 3338477 AS fee FROM terms GROUP BY e)"""


@query(f"""WITH {BLOB_SQL}, t AS (SELECT *, sum(gas_used) OVER (PARTITION BY block_number ORDER BY reward, tx_hash ROWS UNBOUNDED PRECEDING) AS cum, sum(gas_used) OVER (PARTITION BY block_number) AS total FROM txs),
p AS (SELECT block_number, coalesce(min(reward) FILTER (cum >= floor(total * 25 / 100)), max(reward)) AS p25, coalesce(min(reward) FILTER (cum >= floor(total * 75 / 100)), max(reward)) AS p75 FROM t GROUP BY 1)
SELECT k.block_number, base_fee, CAST({NEXT_BASE} AS BIGINT) AS next_base_fee, round(gas_used / 50000.0, 6) AS gas_used_ratio, f.fee::VARCHAR AS blob_fee, g.fee::VARCHAR AS next_blob_fee,
round(blob_used / 786432.0, 6) AS blob_gas_used_ratio, p25 || ';' || p75 AS rewards
FROM blocks k JOIN fee f ON f.e = excess JOIN fee g ON g.e = greatest(excess + blob_used - 393216, 0) JOIN p ON p.block_number = k.block_number""")
def fee_history(s, d):
    out = fees.fee_history(blocks(s, d), ad.txs(s, d), (25, 75))
    return out.withColumns({"next_base_fee": F.col("next_base_fee").cast("long"), "gas_used_ratio": F.round("gas_used_ratio", 6), "blob_gas_used_ratio": F.round("blob_gas_used_ratio", 6), "blob_fee": F.col("blob_fee").cast("string"), "next_blob_fee": F.col("next_blob_fee").cast("string"), "rewards": ad.joined(F.col("rewards"))})


# --- inspection: keys of known classes, made from order keys
H = "%064x"
MADE = (
    ("Headers", "68%016x" + H), ("Bodies", "62%016x" + H), ("Receipt lists", "72%016x" + H), ("Difficulties", "68%016x" + H + "74"), ("Block number->hash", "68%016x6e"),
    ("Block hash->number", "48" + H), ("Path trie state lookups", "4c" + H), ("Path trie account nodes", "41%010x"), ("Path trie storage nodes", "4f" + H + "%06x"), ("Contract codes", "63" + H),
    ("Transaction index", "6c" + H), ("Account snapshot", "61" + H), ("Storage snapshot", "6f" + H + H), ("Trie preimages", "7365637572652d6b65792d" + H), ("Bloombit index", "42%020x" + H),
    ("Beacon sync headers", "53%016x"), ("Clique snapshots", "636c697175652d" + H), ("CHT trie nodes", "6368742d%08x"), ("Bloom trie nodes", "626c742d%08x"), ("Verkle trie nodes", "7641%06x"),
    ("Verkle trie state lookups", "764c" + H), ("Singleton metadata", "657468657265756d2d636f6e6669672d" + H), ("unaccounted", "68%016x00"), ("unaccounted", "63%08x"),
)


@query(
    "WITH made AS (SELECT * FROM (VALUES "
    + ", ".join(f"({i}, '{kind}', {len(form.replace('%064x', '0' * 64).replace('%016x', '0' * 16).replace('%020x', '0' * 20).replace('%010x', '0' * 10).replace('%08x', '0' * 8).replace('%06x', '0' * 6)) // 2})" for i, (kind, form) in enumerate(MADE))
    + f""") t(i, kind, bytes)), rows AS (SELECT kind, bytes + strlen(o_orderstatus || o_orderpriority) AS b FROM orders JOIN made ON o_orderkey % {len(MADE)} = i),
listed AS (SELECT * FROM (VALUES {", ".join(f"('Key-Value store', '{k}')" for k in inspection.STORE)}, {", ".join(f"('Light client', '{k}')" for k in inspection.LIGHT)}, ('', 'unaccounted')) t(store, kind)),
f AS (SELECT store, listed.kind, count(b) AS n, CAST(coalesce(sum(b), 0) AS BIGINT) AS bytes FROM listed LEFT JOIN rows ON rows.kind = listed.kind GROUP BY ALL)
SELECT * FROM f UNION ALL SELECT '', 'Total', CAST(sum(n) AS BIGINT), CAST(sum(bytes) AS BIGINT) FROM f"""
)
def kv_inspect_strict(s, d):
    o = ad.table(s, d, "orders")
    forms = [F.format_string(form, *[F.col("o_orderkey")] * form.count("%")) for _, form in MADE]
    key = F.unhex(F.get(F.array(*forms), (F.col("o_orderkey") % len(MADE)).cast("int")))
    return inspection.inspect(o.select(key.alias("key"), F.concat("o_orderstatus", "o_orderpriority").cast("binary").alias("value")))


@query(f"""WITH {KV}, v AS (SELECT lang, strlen(key) AS k, strlen(value) AS v FROM kv), x AS (SELECT lang, 'key' AS part, k // 16 * 16 AS size FROM v UNION ALL SELECT lang, 'value', v // 16 * 16 FROM v UNION ALL SELECT lang, 'kv', (k + v) // 16 * 16 FROM v),
h AS (SELECT lang, part, size, count(*) AS n FROM x GROUP BY ALL), g AS (SELECT lang, part, unnest(generate_series(min(size), max(size), 16)) AS size FROM h GROUP BY lang, part)
SELECT g.lang, g.part, CAST(g.size AS BIGINT) AS size, CAST(coalesce(h.n, 0) AS BIGINT) AS n FROM g LEFT JOIN h ON h.lang = g.lang AND h.part = g.part AND h.size = g.size""")
def kv_size_histograms(s, d):
    kv, k, v = ad.kv(s, d), F.octet_length("key"), F.octet_length("value")
    each = [a.size_histogram(kv, "lang", size, 16).select("lang", F.lit(part).alias("part"), F.col("bucket").alias("size"), "n") for part, size in (("key", k), ("value", v), ("kv", k + v))]
    return each[0].unionByName(each[1]).unionByName(each[2])


@query(f"SELECT category, bucket, id, n FROM ({SQL['distribution_merge']})")
def distribution_without_key(s, d):
    return a.ranked_wide(a.key_counts(ad.trace(s, d)), ["category", "bucket"]).drop("key")


@query(f"SELECT cat1, cat2, freq, row_number() OVER (ORDER BY freq DESC, cat1, cat2) AS place FROM ({SQL['category_pair_freq']})")
def category_pairs_by_freq(s, d):
    from pyspark.sql import Window

    # at most some 1,400 pairs of categories: one task numbers them
    by = Window.orderBy(F.desc("freq"), "cat1", "cat2")
    return a.category_pairs(categorised(s, d), []).withColumn("place", F.row_number().over(by).cast("long"))


# --- pools, queues, nodes
def nonces(s, d):
    return ad.txs(s, d).select(F.col("sender").alias("account"), F.col("tx_hash").alias("nonce"), "reward")


@query(f"WITH {TXS} SELECT sender AS account, tx_hash AS nonce, NOT (sender % 3 = 0 AND tx_hash < 2000) AS kept FROM txs")
def pool_forward(s, d):
    least = ad.txs(s, d).where("sender % 3 = 0").select(F.col("sender").alias("account"), F.lit(2000).cast("long").alias("least")).distinct()
    kept, removed = queues.forward(nonces(s, d), least)
    return kept.select("account", "nonce", F.lit(True).alias("kept")).unionByName(removed.select("account", "nonce", F.lit(False).alias("kept")))


@query(f"WITH {TXS} SELECT account, nonce FROM (SELECT sender AS account, tx_hash AS nonce, row_number() OVER (PARTITION BY sender ORDER BY tx_hash) AS r FROM txs) WHERE r <= 3")
def pool_cap(s, d):
    return queues.cap(nonces(s, d), 3)[0].select("account", "nonce")


@query(f"WITH {TXS} SELECT sender AS account, '{{' || string_agg('\"' || tx_hash || '\":\"' || reward || '\"', ',' ORDER BY tx_hash) || '}}' AS content FROM txs GROUP BY 1")
def pool_content(s, d):
    return queues.pool_content(nonces(s, d), F.col("reward").cast("string")).withColumn("content", F.to_json("content"))


@query(f"WITH {TXS} SELECT account, nonce, row_number() OVER (ORDER BY low DESC, head, account, nonce) AS place FROM (SELECT *, min(tx_hash) OVER (PARTITION BY account, low) AS head FROM (SELECT sender AS account, tx_hash AS nonce, tx_hash, min(reward) OVER (PARTITION BY sender ORDER BY tx_hash) AS low FROM txs WHERE block_number < 5))")
def pool_by_price(s, d):
    from pyspark.sql import Window

    p = ad.txs(s, d).where("block_number < 5").select(F.col("sender").alias("account"), F.col("tx_hash").alias("nonce"), F.col("reward").alias("price"), F.col("tx_hash").alias("time"))
    ordered = pool.by_price(p).select("account", "nonce", F.monotonically_increasing_id().alias("i"))
    return ordered.select("account", "nonce", F.row_number().over(Window.orderBy("i")).cast("long").alias("place"))


@query("SELECT s_suppkey, s_acctbal FROM supplier WHERE s_acctbal >= 5000")
def queue_pop_until(s, d):
    return queues.pop_until(ad.table(s, d, "supplier").select("s_suppkey", "s_acctbal"), "s_acctbal", 5000, "s_suppkey")


@query("WITH r AS (SELECT user_id AS id, event_id AS place, event_id % 97 AS seq FROM events ORDER BY event_id LIMIT 400) SELECT id, place, seq FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC, place) AS n FROM r) WHERE n = 1")
def first_nodes(s, d):
    rows = ad.table(s, d, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("place"), (F.col("event_id") % 97).alias("seq"))
    return queues.first_nodes(rows, 400, "place").select("id", "place", "seq")


@query("""WITH n AS (SELECT user_id AS id, min(ts) AS a, max(ts) AS z, max(event_id) AS e FROM events GROUP BY 1)
SELECT id FROM n WHERE id % 7 BETWEEN 4 AND 5 AND epoch_us(z) - epoch_us(a) >= 20 * 86400 * 1000000::BIGINT AND e % 3 < 2 AND e % 2 = 0""")
def node_filter_all(s, d):
    u, e = F.col("id"), F.col("e")
    n = ad.table(s, d, "events").groupBy(F.col("user_id").alias("id")).agg(F.min("ts").alias("first_response"), F.max("ts").alias("last_response"), F.max("event_id").alias("e"))
    record = F.map_concat(F.create_map(F.lit("eth"), F.concat(F.lit("fork"), (e % 3).cast("string"))), F.when(e % 2 == 0, F.create_map(F.lit("snap"), F.lit(""))).otherwise(F.create_map(F.lit("none"), F.lit(""))))
    n = n.withColumns({"ip": F.concat(F.lit("10."), (u % 7).cast("string"), F.lit(".1.9")), "record": record})
    return queues.node_filter(n, "10.4.0.0/15", 20 * 86400, ("fork0", "fork1"), snap=True).select("id")


@query("SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS turn FROM events")
def fair_mix(s, d):
    return queues.fair_mix(ad.table(s, d, "events").select("event_id", "event_type"), "event_type", "event_id")


# --- tracers
def steps(s, d):
    return ad.txs(s, d).select(F.col("sender").alias("tx"), F.col("tx_hash").alias("seq"), (F.col("gas_used") % 4).cast("int").alias("depth"), "status", F.col("status").alias("op"))


@query(f"""WITH {TXS} SELECT sender AS tx, 'depths' AS tracer, '{{"deepest":' || max(gas_used % 4) || ',"steps":' || count(*) || '}}' AS result FROM txs GROUP BY 1
UNION ALL SELECT sender, 'opcodes', '{{"kinds":' || count(DISTINCT status) || ',"steps":' || count(*) || '}}' FROM txs GROUP BY 1""")
def tracers_in_one_pass(s, d):
    return pool.run_tracers(["depths", "opcodes"], steps(s, d))


@query()
def call_trees(s, d):
    return pool.run_tracer("call_tree", steps(s, d))


pool.tracer("bigrams", "tx long, bigrams string")(plugins.stepwise(plugins.Bigrams))


@query(f"""WITH {TXS}, g AS (SELECT sender AS tx, lag(status) OVER (PARTITION BY sender ORDER BY tx_hash) || '-' || status AS gram FROM txs), k AS (SELECT tx, gram, count(*) AS n FROM g WHERE gram IS NOT NULL GROUP BY ALL)
SELECT t.tx, '{{' || coalesce(string_agg('"' || gram || '":' || n, ',' ORDER BY gram), '') || '}}' AS bigrams FROM (SELECT DISTINCT sender AS tx FROM txs) t LEFT JOIN k ON k.tx = t.tx GROUP BY 1""")
def tracer_user_bigrams(s, d):
    return pool.run_tracer("bigrams", steps(s, d))


@query("SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN n_name ELSE c_mktsegment END AS c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey")
def lookup_overrides(s, d):
    x = ad.table(s, d, "customer").join(ad.table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    other = x.where("c_custkey % 10 = 0").select("c_custkey", F.col("n_name").alias("c_mktsegment"))
    return plugins.resolved(x.select("c_custkey", "c_mktsegment"), other, ["c_custkey"])


@query("SELECT o_orderkey, o_custkey AS a, o_orderstatus AS b FROM orders")
def rlp_structs(s, d):
    word = lambda c: codecs.trim_zeros(codecs.from_hex(F.hex(c)))
    coded = ad.table(s, d, "orders").select("o_orderkey", codecs.rlp_list(F.array(word(F.col("o_custkey")), F.col("o_orderstatus").cast("binary"))).alias("r"))
    return coded.select("o_orderkey", plugins.rlp_as("a long, b string")("r").alias("v")).select("o_orderkey", "v.a", "v.b")


@query("SELECT lower(hex('secure-key-' || o_orderkey)) AS key, o_orderstatus AS value FROM orders WHERE o_orderkey % 2 = 0")
def export_preimages(s, d):
    o = ad.table(s, d, "orders")
    key = F.concat(F.when(F.col("o_orderkey") % 2 == 0, "secure-key-").otherwise("x"), F.col("o_orderkey").cast("string")).cast("binary")
    out = plugins.EXPORTERS["preimage"](o.select(key.alias("key"), F.col("o_orderstatus").cast("binary").alias("value")))
    return out.select(F.lower(F.hex("key")).alias("key"), F.col("value").cast("string").alias("value"))


@query(f"WITH {TXS}, x AS (SELECT sender AS tx, status AS slot, arg_min(reward, tx_hash) AS pre, arg_max(reward + gas_used % 2, tx_hash) AS post FROM txs GROUP BY ALL) SELECT tx, slot, pre, post FROM x WHERE pre <> post")
def prestate_diff(s, d):
    t = ad.txs(s, d).select(F.col("sender").alias("tx"), F.col("tx_hash").alias("seq"), F.lit("a").alias("address"), F.col("status").alias("slot"), F.col("reward").alias("before"), (F.col("reward") + F.col("gas_used") % 2).alias("after"))
    return queues.prestate(t, diff=True).drop("address")


# --- codecs as columns
@query("SELECT o_orderkey, o_orderstatus AS status, CAST(strlen(o_orderpriority) AS BIGINT) AS n, lower(hex(o_orderpriority)) AS priority FROM orders")
def rlp_columns(s, d):
    o = ad.table(s, d, "orders")
    coded = o.select("o_orderkey", codecs.rlp_list(F.array(F.col("o_orderstatus").cast("binary"), F.col("o_orderpriority").cast("binary"))).alias("r"))
    items = coded.select("o_orderkey", codecs.rlp_items("r").alias("i"))
    return items.select("o_orderkey", F.get("i", F.lit(0)).cast("string").alias("status"), F.octet_length(F.get("i", F.lit(1))).cast("long").alias("n"), F.lower(F.hex(F.get("i", F.lit(1)))).alias("priority"))


@query("SELECT o_orderkey, o_custkey::VARCHAR AS a, CASE WHEN o_custkey % 2 = 1 THEN 'true' ELSE 'false' END AS b FROM orders")
def abi_columns(s, d):
    o = ad.table(s, d, "orders")
    word = lambda x: codecs.left_pad(codecs.from_hex(F.hex(x)), 32)
    data = F.concat(word(F.col("o_custkey")), word(F.col("o_custkey") % 2))
    x = o.select("o_orderkey", codecs.abi_values(["uint256", "bool"])(data).alias("v"))
    return x.select("o_orderkey", F.get("v", F.lit(0)).alias("a"), F.get("v", F.lit(1)).alias("b"))


@query("SELECT p_partkey, '0x' || lpad(lower(hex(p_name)), greatest(32, 2 * strlen(p_name))::INTEGER, '0') AS l, '0x' || rpad(lower(hex(p_name)), greatest(32, 2 * strlen(p_name))::INTEGER, '0') AS r FROM part")
def hex_pads(s, d):
    n = F.col("p_name").cast("binary")
    return ad.table(s, d, "part").select("p_partkey", codecs.to_hex(codecs.left_pad(n, 16)).alias("l"), codecs.to_hex(codecs.right_pad(n, 16)).alias("r"))


# --- streams
def stored(rows, purpose):
    """rows as files of the shared folder, for a stream to read."""
    path = work_folder(rows.sparkSession, purpose)
    rows.write.parquet(path)
    return path


@query(f"WITH {TRACE} SELECT op_type, key, count(*) AS n FROM trace GROUP BY ALL")
def stream_trace_tail(s, d):
    from marlstone.sources import grammar

    path = work_folder(s, "trace")
    ad.trace(s, d).select(grammar.to_lines(F.col("op_type"), F.col("key"), F.lit(1))).write.text(path)
    lines = streams.drained(streams.tail(s, path).select("op_type", "key"))
    return lines.groupBy("op_type", "key").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT l_orderkey // 100 AS block_number, l_orderkey // 100 % 13 AS hash FROM lineitem")
def stream_new_heads(s, d):
    x = streams.read(s, f"{d}/lineitem.parquet").select(F.floor(F.col("l_orderkey") / 100).alias("block_number"))
    return streams.drained(streams.new_heads(x.withColumn("hash", F.col("block_number") % 13)))


@query(SQL["signed_log_counts"])
def stream_signed_counts(s, d):
    x = streams.read(s, f"{d}/events.parquet").withColumn("removed", F.col("event_id") % 3 == 0)
    return streams.drained(streams.signed_counts(x, "event_type"), "complete")


@query("SELECT event_id, event_type FROM events WHERE event_type IN ('view', 'click')")
def stream_joined(s, d):
    x = streams.read(s, f"{d}/events.parquet").select("event_id", "event_type")
    return streams.drained(streams.joined([x.where("event_type = 'view'"), x.where("event_type = 'click'")]))


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(min(value), 6) AS low, round(max(value), 6) AS high, round(avg(value), 6) AS mean FROM events GROUP BY ALL")
def stream_timer_scrapes(s, d):
    x = streams.drained(streams.scrapes(streams.read(s, f"{d}/events.parquet"), "event_type", "value", "1 day"), "complete")
    return x.withColumns({k: F.round(k, 6) for k in ("low", "high", "mean")})


ALPHA = {m: 1 - math.exp(-5 / 60 / m) for m in (1, 5, 15)}


@query(f"""WITH RECURSIVE d AS (SELECT event_type AS name, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS tick, count(*) AS n FROM events GROUP BY ALL),
g AS (SELECT name, unnest(generate_series(min(tick), max(tick))) AS tick FROM d GROUP BY name),
f AS (SELECT g.name, g.tick, d.n IS NOT NULL AS given, coalesce(n, 0) AS n, row_number() OVER (PARTITION BY g.name ORDER BY g.tick) AS i FROM g LEFT JOIN d ON d.name = g.name AND d.tick = g.tick),
r AS (SELECT name, tick, given, n, i, n AS total, n / 5.0::DOUBLE AS r1, n / 5.0::DOUBLE AS r5, n / 5.0::DOUBLE AS r15 FROM f WHERE i = 1
UNION ALL SELECT f.name, f.tick, f.given, f.n, f.i, total + f.n, {", ".join(f"r{m} + {x!r}::DOUBLE * (f.n / 5.0::DOUBLE - r{m})" for m, x in ALPHA.items())} FROM r JOIN f ON f.name = r.name AND f.i = r.i + 1)
SELECT name, CAST(tick AS BIGINT) AS tick, n, round(total / (i * 5.0::DOUBLE), 6) AS mean, round(r1, 6) AS rate1, round(r5, 6) AS rate5, round(r15, 6) AS rate15 FROM r WHERE given""")
def stream_meter(s, d):
    ticks = ad.table(s, d, "events").groupBy(F.col("event_type").alias("name"), F.datediff(F.to_date("ts"), F.lit("2024-01-01")).cast("long").alias("tick")).agg(F.count("*").alias("n"))
    x = streams.drained(streams.meters(streams.read(s, stored(ticks, "ticks"))))
    return x.withColumns({k: F.round(k, 6) for k in ("mean", "rate1", "rate5", "rate15")})


@query("""WITH h AS (SELECT event_type AS chain, event_id AS seq, event_id // 4 AS head FROM events), k AS (SELECT *, CASE WHEN head >= 16 THEN (head + 1 - 16) // 32 ELSE 0 END AS known FROM h),
s AS (SELECT chain, unnest(generate_series(0, max(known) - 1)) AS section FROM k GROUP BY chain) SELECT s.chain, CAST(s.section AS BIGINT) AS section, min(seq) AS seq FROM s JOIN k ON k.chain = s.chain AND known > section GROUP BY ALL""")
def stream_sections(s, d):
    e = streams.read(s, f"{d}/events.parquet")
    heads = e.select(F.col("event_type").alias("chain"), F.col("event_id").alias("seq"), F.floor(F.col("event_id") / 4).alias("head"), F.lit(False).alias("reorg"))
    done = streams.drained(streams.section_events(heads, 32, 16))
    return done.where("action = 'commit'").select("chain", "section", "seq")


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 1 ELSE 2 END AS call FROM events WHERE event_type = 'error'")
def stream_polls(s, d):
    """Two calls of one poll, with files that come between them."""
    path = work_folder(s, "polled")
    e = ad.table(s, d, "events").where("event_type = 'error'").select("event_id")
    e.where("event_id % 2 = 0").write.mode("append").parquet(path)
    poll = streams.Poll(streams.read(s, path))
    first = poll.changes()
    e.where("event_id % 2 = 1").write.mode("append").parquet(path)
    return first.withColumn("call", F.lit(1)).unionByName(poll.changes().withColumn("call", F.lit(2)))


@query(f"WITH {LOGS} SELECT block_number // 8 AS section, count(*) AS n FROM logs WHERE block_number // 8 < ((SELECT max(block_number) FROM logs) - 5 + 1 - 4) // 8 GROUP BY 1")
def sections_after_reorg(s, d):
    """Logs of the sections that stay after the head has gone to the top and a reorg has taken it five blocks back."""
    logs = ad.logs(s, d)
    top = logs.agg(F.max("block_number")).first()[0] or 0
    heads = s.createDataFrame([("main", 0, top, False), ("main", 1, max(0, top - 5 - 4), True)], "chain string, seq long, head long, reorg boolean")
    live = streams.live_sections(streams.drained(streams.section_events(streams.read(s, stored(heads, "heads")), 8, 4)))
    return c.log_filter(logs).withColumn("section", F.floor(F.col("block_number") / 8)).join(live, "section", "left_semi").groupBy("section").agg(F.count("*").alias("n"))
