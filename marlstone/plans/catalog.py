"""Every operator as a query over the driver tables, beside its DuckDB SQL (None where SQL can't express it)."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.operators import access as a
from marlstone.operators import chain as c
from marlstone.plans import adapters as ad
from marlstone.plans.adapters import KV, LOGS, TRACE, TXS
from marlstone.sources import grammar
from marlstone.streaming import streams

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def keep(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return keep


def batched(s, d):
    return ad.trace(s, d).withColumn("batch", a.batch_of(F.col("block_id"), 0, 5))


# --- operation counts and distributions
@query(f"WITH {TRACE} SELECT category, op_type, count(*) AS n FROM trace GROUP BY ALL")
def op_count_by_category(s, d):
    return a.op_counts(ad.trace(s, d))


@query(f"WITH {TRACE} SELECT batch, category, op_type, count(*) AS n FROM trace GROUP BY ALL")
def op_count_by_batch(s, d):
    return a.op_counts(batched(s, d), "batch")


@query(f"WITH {TRACE}, k AS (SELECT batch, category, bucket, key, count(*) AS n FROM trace GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY batch, category, bucket ORDER BY n DESC, key) AS id, count(*) OVER (PARTITION BY batch, category, bucket) AS c FROM k) SELECT batch, category, bucket, key, n, id FROM r WHERE c > 1")
def key_distribution_ranked(s, d):
    return a.ranked_wide(a.key_counts(batched(s, d), "batch"), ["batch", "category", "bucket"], 2)


@query(f"WITH {TRACE}, k AS (SELECT category, bucket, key, count(*) AS n FROM trace GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY category, bucket ORDER BY n DESC, key) AS id FROM k")
def distribution_merge(s, d):
    parts = a.key_counts(batched(s, d), "batch")
    return a.ranked_wide(parts.groupBy("category", "bucket", "key").agg(F.sum("n").alias("n")), ["category", "bucket"])


@query(SQL["distribution_merge"])
def distribution_ranked_wide(s, d):
    return a.ranked_wide(a.key_counts(ad.trace(s, d)), ["category", "bucket"])


@query(f"WITH {TRACE} SELECT category, op_type, count(*) AS n FROM trace GROUP BY ALL")
def count_merge(s, d):
    return a.op_counts(batched(s, d), "batch").groupBy("category", "op_type").agg(F.sum("n").alias("n"))


@query(f"WITH {TRACE}, l AS (SELECT seq, 'OPType: ' || op_type || CASE op_type WHEN 'NewIterator' THEN ', prefix: ' || key || ', start key: ' ELSE ', key: ' || key || ', size: 3' END || CASE WHEN op_type IN ('Put', 'BatchPut') THEN ', value: 00, size: 1' ELSE '' END AS line, op_type, key FROM trace) SELECT seq, line, op_type, key, CASE WHEN op_type <> 'NewIterator' THEN 3 END AS key_size, CASE WHEN op_type IN ('Put', 'BatchPut') THEN 1 END AS value_size FROM l")
def trace_line_round_trip(s, d):
    t = ad.trace(s, d)
    lines = t.select("seq", grammar.to_lines(F.col("op_type"), F.col("key"), F.lit(1)).alias("line"))
    return grammar.parse(lines).drop("start_id", "end_id")


# --- updates
UPDATES = f"""{TRACE}, snap AS (SELECT DISTINCT key FROM trace WHERE op_type = 'Put' AND block_id >= 28),
u AS (SELECT t.*, CASE WHEN op_type IN ('Put', 'BatchPut') AND (s.key IS NOT NULL OR row_number() OVER (PARTITION BY t.key, op_type IN ('Put', 'BatchPut') ORDER BY seq) > 1) THEN 'Update' ELSE op_type END AS new_op FROM trace t LEFT JOIN snap s ON t.key = s.key)"""


def updated(s, d):
    t = ad.trace(s, d)
    return a.classify_updates(t, t.where("op_type = 'Put' AND block_id >= 28"))


@query(f"WITH {UPDATES} SELECT seq, key, op_type, new_op FROM u")
def update_classification(s, d):
    return updated(s, d).select("seq", "key", "op_type", "new_op")


@query(f"WITH {UPDATES} SELECT category, new_op, count(*) AS n FROM u GROUP BY ALL")
def update_counts(s, d):
    return updated(s, d).groupBy("category", "new_op").agg(F.count("*").alias("n"))


@query(f"WITH {UPDATES} SELECT seq, replace('OPType: ' || op_type || ', key: ' || key, 'OPType: ' || op_type, 'OPType: ' || new_op) AS line FROM u")
def rewritten_trace(s, d):
    line = F.concat(F.lit("OPType: "), "op_type", F.lit(", key: "), "key")
    return updated(s, d).select("seq", grammar.rewrite_updates(line, F.col("new_op") == "Update").alias("line"))


# --- sizes
@query(f"WITH {KV} SELECT lang, count(*) AS n, round(sum(strlen(key) + strlen(value)) / count(*), 2) AS avg_kv, min(strlen(key)) AS min_key, min(strlen(value)) AS min_value, min(strlen(key) + strlen(value)) AS min_kv, max(strlen(key)) AS max_key, max(strlen(value)) AS max_value, max(strlen(key) + strlen(value)) AS max_kv FROM kv GROUP BY lang")
def kv_size_summary(s, d):
    return a.size_summary(ad.kv(s, d), "lang")


@query(f"WITH {KV}, v AS (SELECT lang, key, strlen(value) AS size FROM kv), z AS (SELECT lang, max(key) AS k FROM v WHERE size = 0 GROUP BY lang) SELECT v.lang, CAST(coalesce(min(CASE WHEN k IS NULL OR key > k THEN size END), 0) AS BIGINT) AS min_value FROM v LEFT JOIN z ON v.lang = z.lang GROUP BY v.lang")
def kv_min_after_zero(s, d):
    return a.min_after_zero(ad.kv(s, d), "lang")


@query(f"WITH {KV}, h AS (SELECT lang, strlen(value) // 100 * 100 AS bucket, count(*) AS n FROM kv GROUP BY ALL), g AS (SELECT lang, unnest(generate_series(min(bucket), max(bucket), 100)) AS bucket FROM h GROUP BY lang) SELECT g.lang, CAST(g.bucket AS BIGINT) AS bucket, CAST(coalesce(h.n, 0) AS BIGINT) AS n FROM g LEFT JOIN h ON g.lang = h.lang AND g.bucket = h.bucket")
def kv_size_histogram_gapfill(s, d):
    return a.size_histogram(ad.kv(s, d), "lang", F.octet_length("value"), 100)


@query(f"WITH {KV}, x AS (SELECT CASE WHEN lang = 'en' AND strlen(key) = 7 THEN 'en7' WHEN lang = 'de' THEN 'de' WHEN key LIKE 'src1%' THEN 'src1' ELSE 'unaccounted' END AS kind, strlen(key) + strlen(value) AS b FROM kv) SELECT coalesce(kind, 'total') AS kind, count(*) AS n, CAST(sum(b) AS BIGINT) AS bytes FROM x GROUP BY ROLLUP (kind)")
def kv_inspect(s, d):
    k = F.col("key")
    kind = F.when((F.col("lang") == "en") & (F.octet_length(k) == 7), "en7").when(F.col("lang") == "de", "de").when(k.startswith("src1"), "src1").otherwise("unaccounted")
    rows = ad.kv(s, d).select(kind.alias("kind"), (F.octet_length("key") + F.octet_length("value")).alias("b"))
    return rows.rollup("kind").agg(F.count("*").alias("n"), F.sum("b").alias("bytes")).withColumn("kind", F.coalesce("kind", F.lit("total")))


# --- co-access
def days(distance: int) -> int:
    """Days of a segment: a day has too few reads for the larger distances."""
    return 1 if distance < 64 else 30


def pair_sql(d: int, op: str, least: int = 2) -> str:
    rows = "u WHERE new_op = 'Update'" if op == "Update" else "trace WHERE op_type = 'Get'"
    return f"""WITH {UPDATES}, p AS (SELECT block_id, block_id // 10 AS batch, key, lag(key, {d + 1}) OVER (PARTITION BY block_id // {days(d)} ORDER BY seq) AS o FROM {rows}),
q AS (SELECT batch, least(key, o) AS k1, greatest(key, o) AS k2, count(*) AS freq, list_sort(list(DISTINCT block_id)) AS bl FROM p WHERE o IS NOT NULL GROUP BY ALL HAVING count(*) >= {least})
SELECT k1, k2, CAST(sum(freq) AS BIGINT) AS freq, array_to_string(list_sort(flatten(list(bl))), ';') AS blocks FROM q GROUP BY k1, k2"""


def pairs(s, d, distances, op="Get", days=1):
    rows = ad.trace(s, d).where("op_type = 'Get'") if op == "Get" else updated(s, d).where("new_op = 'Update'")
    rows = rows.select(F.floor(F.col("block_id") / days).alias("segment_id"), "block_id", F.floor(F.col("block_id") / 10).alias("batch"), "seq", "key")
    return a.merge_pairs(a.pair_counts(a.neighbours(rows, distances), ["distance", "batch"]), ["distance"])


for _op, _ds in (("Get", a.DISTANCES), ("Update", (0, 1, 4))):
    for _d in _ds:

        @query(pair_sql(_d, _op), ("read" if _op == "Get" else "update") + f"_pairs_d{_d}")
        def one_distance(s, d, _op=_op, _d=_d):
            return pairs(s, d, (_d,), _op, days(_d)).select("k1", "k2", "freq", ad.joined(F.col("blocks")).alias("blocks"))


@query("WITH " + TRACE + ", x AS (" + " UNION ALL ".join(f"SELECT {n} AS distance, key, lag(key, {n + 1}) OVER (PARTITION BY block_id ORDER BY seq) AS o FROM trace WHERE op_type = 'Get'" for n in a.DISTANCES) + ") SELECT distance, count(*) AS pairs, count(DISTINCT least(key, o) || greatest(key, o)) AS kinds FROM x WHERE o IS NOT NULL GROUP BY distance")
def read_pairs_all_distances(s, d):
    rows = ad.trace(s, d).where("op_type = 'Get'").select("segment_id", "seq", "key")
    each = a.neighbours(rows).groupBy("distance", "k1", "k2").agg(F.count("*").alias("n"))
    return each.groupBy("distance").agg(F.sum("n").alias("pairs"), F.count("*").alias("kinds"))


@query(f"WITH {TRACE}, p AS (SELECT block_id // 10 AS batch, key, lag(key) OVER (PARTITION BY block_id ORDER BY seq) AS o FROM trace WHERE op_type = 'Get'), q AS (SELECT batch, least(key, o) AS k1, greatest(key, o) AS k2, count(*) AS freq FROM p WHERE o IS NOT NULL GROUP BY ALL HAVING count(*) > 1) SELECT k1, k2, CAST(sum(freq) AS BIGINT) AS freq, count(*) AS parts FROM q GROUP BY k1, k2")
def pair_merge_batches(s, d):
    rows = ad.trace(s, d).where("op_type = 'Get'").withColumn("batch", F.floor(F.col("block_id") / 10)).select("segment_id", "block_id", "batch", "seq", "key")
    return a.pair_counts(a.neighbours(rows, (0,)), ["batch"]).groupBy("k1", "k2").agg(F.sum("freq").alias("freq"), F.count("*").alias("parts"))


CATEGORY_PAIRS = f"WITH {TRACE}, p AS (SELECT category AS c, lag(category) OVER (PARTITION BY block_id ORDER BY seq) AS o FROM trace WHERE op_type = 'Get'), q AS (SELECT least(c, o) AS cat1, greatest(c, o) AS cat2 FROM p WHERE o IS NOT NULL) SELECT cat1, cat2, count(*) AS freq FROM q GROUP BY "


def categorised(s, d):
    from marlstone.functions.categories import category

    rows = ad.trace(s, d).where("op_type = 'Get'").select("segment_id", "block_id", "seq", "key")
    return a.pair_counts(a.neighbours(rows, (0,)), [], 1).withColumns({"c1": category(F.col("k1")), "c2": category(F.col("k2"))})


@query(CATEGORY_PAIRS + "cat1, cat2")
def category_pair_freq(s, d):
    return a.category_pairs(categorised(s, d), [])


@query(CATEGORY_PAIRS + "GROUPING SETS ((cat1, cat2), ())")
def category_pair_with_total(s, d):
    return a.category_pairs(categorised(s, d), [], True)


BASKET = "(PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate)"


@query(f"WITH p AS (SELECT l_partkey AS k, lag(l_partkey) OVER {BASKET} AS o FROM lineitem) SELECT least(k, o) AS k1, greatest(k, o) AS k2, count(*) AS freq FROM p WHERE o IS NOT NULL GROUP BY ALL ORDER BY freq DESC, k1, k2 LIMIT 100")
def part_coaccess_top(s, d):
    x = ad.table(s, d, "lineitem")
    seq = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    rows = x.select(F.col("l_orderkey").alias("segment_id"), seq.alias("seq"), F.col("l_partkey").alias("key"))
    return a.neighbours(rows, (0,)).groupBy("k1", "k2").agg(F.count("*").alias("freq")).orderBy(F.desc("freq"), "k1", "k2").limit(100)


@query(f"WITH {TRACE} SELECT op_type AS gram, count(*) AS n FROM trace GROUP BY 1")
def op_unigrams(s, d):
    return ad.trace(s, d).groupBy(F.col("op_type").alias("gram")).agg(F.count("*").alias("n"))


@query(f"WITH {TRACE}, x AS (SELECT coalesce(lag(op_type) OVER (PARTITION BY user_id ORDER BY seq), '') || '-' || op_type AS gram FROM trace) SELECT gram, count(*) AS n FROM x GROUP BY 1")
def op_bigrams(s, d):
    return a.grams(ad.trace(s, d), 2, "user_id")


@query(f"WITH {TRACE}, x AS (SELECT lag(op_type, 2) OVER w || '-' || lag(op_type) OVER w || '-' || op_type AS gram FROM trace WINDOW w AS (PARTITION BY user_id ORDER BY seq)) SELECT gram, count(*) AS n FROM x WHERE gram IS NOT NULL GROUP BY 1")
def op_trigrams(s, d):
    return a.grams(ad.trace(s, d), 3, "user_id")


# --- logs and transactions
LOG_COLUMNS = ["block_number", "tx_hash", "pos", "address", "data"]


def log_query(where: str, **criteria):
    return f"WITH {LOGS} SELECT block_number, tx_hash, pos, address, data FROM logs WHERE {where}", lambda s, d: c.log_filter(ad.logs(s, d, criteria.get("first"), criteria.get("last")), **criteria).select(*LOG_COLUMNS)


for _name, (_sql, _f) in {
    "log_filter_positional": log_query("address IN (1, 2, 3) AND t0 IN ('R', 'A') AND t1 = 'F'", addresses=(1, 2, 3), topics=(("R", "A"), ("F",))),
    "log_filter_wildcard": log_query("t1 = 'O'", topics=((), ("O",))),
    "log_filter_range": log_query("block_number BETWEEN 10 AND 20 AND address = 7", first=10, last=20, addresses=(7,)),
}.items():
    query(_sql, _name)(_f)


@query(f"WITH {LOGS}, {TXS} SELECT l.block_number, l.tx_hash, l.pos, l.data, t.sender FROM logs l JOIN txs t ON l.block_number = t.block_number AND l.tx_hash = t.tx_hash WHERE l.address = 5")
def log_enrich_tx(s, d):
    return c.log_filter(ad.logs(s, d), addresses=(5,)).join(ad.txs(s, d), ["block_number", "tx_hash"]).select("block_number", "tx_hash", "pos", "data", "sender")


@query(f"WITH {TXS} SELECT tx_hash, block_number, sender FROM txs WHERE tx_hash IN (1, 3, 32, 33, 100, 777)")
def tx_lookup(s, d):
    return ad.txs(s, d).where(F.col("tx_hash").isin(1, 3, 32, 33, 100, 777)).select("tx_hash", "block_number", "sender")


ORDER = ["tx_hash", "pos", "data", "address", "gas_used", "price"]


@query(f"WITH {LOGS}, x AS (SELECT *, sum(gas_used) OVER (PARTITION BY block_number ORDER BY {', '.join(ORDER)} ROWS UNBOUNDED PRECEDING) AS cum FROM logs) SELECT block_number, tx_hash, pos, data, CAST(cum AS BIGINT) AS cum, gas_used FROM x")
def gas_used_deaccumulate(s, d):
    from pyspark.sql import Window

    w = Window.partitionBy("block_number").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    x = ad.logs(s, d).withColumn("cum", F.sum("gas_used").over(w))
    return x.select("block_number", "tx_hash", "pos", "data", "cum", c.deaccumulate(x, "cum", "block_number", [*ORDER, "cum"]).alias("gas_used"))


@query(f"WITH {LOGS} SELECT block_number, tx_hash, pos, data, row_number() OVER (PARTITION BY block_number ORDER BY {', '.join(ORDER)}) - 1 AS log_index FROM logs")
def log_index(s, d):
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("block_number").orderBy(*ORDER)).cast("long") - 1
    return ad.logs(s, d).select("block_number", "tx_hash", "pos", "data", n.alias("log_index"))


@query(f"WITH {TXS}, x AS (SELECT *, sum(gas_used) OVER (PARTITION BY block_number ORDER BY reward, tx_hash ROWS UNBOUNDED PRECEDING) AS cum, sum(gas_used) OVER (PARTITION BY block_number) AS a FROM txs), y AS (SELECT *, unnest([10, 50, 90]) AS p FROM x) SELECT block_number, p, coalesce(min(reward) FILTER (cum >= floor(a * p / 100)), max(reward)) AS reward FROM y GROUP BY ALL")
def fee_percentiles(s, d):
    return c.weighted_percentiles(ad.txs(s, d), (10, 50, 90))


@query(f"""WITH {TXS}, near AS (SELECT * FROM txs WHERE block_number > (SELECT max(block_number) FROM txs) - 40 AND reward >= 2000 AND sender % 50 <> block_number % 50),
l AS (SELECT *, row_number() OVER (PARTITION BY block_number ORDER BY reward, tx_hash) AS r FROM near), n AS (SELECT block_number, count(*) AS k FROM l WHERE r <= 3 GROUP BY 1),
b AS (SELECT (SELECT max(block_number) FROM txs) - i AS block_number FROM range(40) t(i)), c AS (SELECT b.block_number, coalesce(k <> 1, true) AS several FROM b LEFT JOIN n ON b.block_number = n.block_number WHERE b.block_number >= 0),
v AS (SELECT list_sort(list(reward)) AS v FROM l WHERE r <= 3 AND (SELECT count(*) FROM c WHERE c.several AND c.block_number > l.block_number) < 20)
SELECT least(v[CAST(floor((len(v) - 1) * 60 / 100) AS BIGINT) + 1], 500000) AS tip FROM v""")
def tip_suggestion(s, d):
    from marlstone.operators import fees

    t = ad.txs(s, d).withColumn("sender", F.col("sender") % 50).withColumn("miner", F.col("block_number") % 50)
    return fees.suggested_tip(t, 20, 3, 60, 2000, 500_000)


@query(f"WITH {TXS} SELECT block_number, round(sum(gas_used) / 30000.0, 6) AS ratio FROM txs GROUP BY 1")
def gas_used_ratio(s, d):
    return ad.txs(s, d).groupBy("block_number").agg(F.round(F.sum("gas_used") / 30000.0, 6).alias("ratio"))


@query(f"WITH {TXS}, b AS (SELECT block_number, CAST(sum(gas_used) AS BIGINT) AS gas FROM txs GROUP BY 1), n AS (SELECT block_number + 1 AS block_number, gas // 8 AS fee FROM b) SELECT coalesce(b.block_number, n.block_number) AS block_number, b.gas, n.fee FROM b FULL JOIN n ON b.block_number = n.block_number")
def next_block_value(s, d):
    b = ad.txs(s, d).groupBy("block_number").agg(F.sum("gas_used").alias("gas"))
    return b.join(b.select((F.col("block_number") + 1).alias("block_number"), F.floor(F.col("gas") / 8).alias("fee")), "block_number", "full")


@query(f"WITH {LOGS}, {TXS}, r AS (SELECT block_number, tx_hash, count(*) AS n_logs FROM logs GROUP BY ALL) SELECT t.block_number, t.tx_hash, t.gas_used, r.n_logs FROM txs t JOIN r ON t.block_number = r.block_number AND t.tx_hash = r.tx_hash")
def receipt_zip_tx(s, d):
    r = ad.logs(s, d).groupBy("block_number", "tx_hash").agg(F.count("*").alias("n_logs"))
    return ad.txs(s, d).join(r, ["block_number", "tx_hash"]).select("block_number", "tx_hash", "gas_used", "n_logs")


@query(f"WITH {LOGS}, {TXS} SELECT l.block_number, c.c_name, count(*) AS n FROM logs l JOIN txs t ON l.tx_hash = t.tx_hash JOIN customer c ON t.sender = c.c_custkey GROUP BY ALL")
def log_tx_block_account(s, d):
    t = ad.txs(s, d).select("tx_hash", "sender").join(ad.table(s, d, "customer"), F.col("sender") == F.col("c_custkey"))
    return ad.logs(s, d).join(t, "tx_hash").groupBy("block_number", "c_name").agg(F.count("*").alias("n"))


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def status_counts(s, d):
    return ad.txs(s, d).groupBy("status").agg(F.count("*").alias("n"))


# --- layers, sets, histories
LAYERS = "layers AS (SELECT user_id AS key, event_id AS layer, value, event_type = 'error' AS gone FROM events)"


def layers(s, d):
    e = ad.table(s, d, "events")
    return e.select(F.col("user_id").alias("key"), F.col("event_id").alias("layer"), "value", (F.col("event_type") == "error").alias("gone"))


STATE = "SELECT key, layer, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY layer DESC) AS r FROM layers WHERE {}) WHERE r = 1 AND NOT gone"


@query(f"WITH {LAYERS} {STATE.format('true')}")
def layered_latest(s, d):
    return c.newest(layers(s, d), ["key"], "layer", F.col("gone")).drop("gone")


def two_states(s, d):
    x = layers(s, d)
    return [c.newest(x.where(F.col("layer") % 100 < n), ["key"], "layer", F.col("gone")).select("key", "value") for n in (50, 100)]


TWO = f"WITH {LAYERS}, a AS ({STATE.format('layer % 100 < 50')}), b AS ({STATE.format('true')}) "


@query(TWO + "SELECT key, value FROM b EXCEPT SELECT key, value FROM a")
def state_diff(s, d):
    return c.changed(*two_states(s, d))


@query(TWO + "SELECT key, value FROM a UNION SELECT key, value FROM b")
def state_union(s, d):
    x, y = two_states(s, d)
    return x.unionByName(y).distinct()


@query(TWO + "SELECT coalesce(a.key, b.key) AS key FROM a FULL JOIN b ON a.key = b.key WHERE a.value IS DISTINCT FROM b.value")
def modified_accounts(s, d):
    x, y = two_states(s, d)
    return x.join(y.withColumnRenamed("value", "new"), "key", "full").where(~F.col("value").eqNullSafe(F.col("new"))).select("key")


@query(f"WITH {LAYERS} SELECT key, max(layer) AS layer FROM layers GROUP BY key")
def upsert_newest(s, d):
    x = layers(s, d)
    old, new = x.where("layer % 2 = 0"), x.where("layer % 2 = 1")
    return c.newest(old.unionByName(new).select("key", "layer"), ["key"], "layer")


@query("SELECT DISTINCT l_orderkey AS tx_hash FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F')")
def dangling_rows(s, d):
    return ad.logs(s, d).select("tx_hash").distinct().join(ad.txs(s, d).where("status <> 'F'"), "tx_hash", "left_anti")


@query("SELECT l_orderkey AS tx_hash, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 100000) GROUP BY 1")
def prune_candidates(s, d):
    live = ad.table(s, d, "orders").where("o_totalprice > 100000").select(F.col("o_orderkey").alias("tx_hash"))
    return ad.logs(s, d).join(live, "tx_hash", "left_anti").groupBy("tx_hash").agg(F.count("*").alias("n"))


@query("SELECT o_custkey AS account, o_orderkey AS block, lag(o_orderkey, 1, 0) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS valid_from FROM orders")
def history_intervals(s, d):
    x = ad.txs(s, d).select(F.col("sender").alias("account"), F.col("tx_hash").alias("block"))
    return c.intervals(x, ["account"], "block", 0)


PREIMAGE = "SELECT c_custkey, n_name FROM customer {} JOIN nation ON c_nationkey = n_nationkey AND n_regionkey < 3"


def preimages(how):
    def f(s, d):
        n = ad.table(s, d, "nation").where("n_regionkey < 3")
        return ad.table(s, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"), how).select("c_custkey", "n_name")

    return f


query(PREIMAGE.format("LEFT"), "account_preimage_left")(preimages("left"))
query(PREIMAGE.format(""), "account_preimage_inner")(preimages("inner"))


# --- paging, filters, attributes
@query("SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 10")
def top_n_score(s, d):
    return ad.table(s, d, "supplier").select("s_suppkey", "s_acctbal").orderBy(F.desc("s_acctbal"), "s_suppkey").limit(10)


@query("WITH p AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS i FROM customer WHERE c_custkey >= 50) SELECT c_custkey, (SELECT c_custkey FROM p WHERE i = 26) AS next_key FROM p WHERE i <= 25")
def keyset_page(s, d):
    return c.keyset_page(ad.table(s, d, "customer").select("c_custkey"), "c_custkey", 50, 25)


@query("WITH p AS (SELECT doc_id, strlen(text) AS size, coalesce(sum(strlen(text)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM documents WHERE doc_id >= 5) SELECT doc_id, size FROM p WHERE b <= 30000")
def byte_capped_page(s, d):
    rows = ad.table(s, d, "documents").select("doc_id", F.octet_length("text").cast("long").alias("size"))
    return c.byte_capped(rows, "doc_id", F.col("size"), 30_000, 5, 1000)


@query("SELECT p_partkey, p_name FROM part WHERE p_name LIKE 'small %' AND p_name >= 'small ' || 'h'")
def prefix_scan(s, d):
    return c.prefix_scan(ad.table(s, d, "part").select("p_partkey", "p_name"), "p_name", "small ", "h")


@query("SELECT p_partkey, p_name FROM part WHERE strlen(p_name) = 8")
def key_length_scan(s, d):
    return ad.table(s, d, "part").select("p_partkey", "p_name").where(F.octet_length("p_name") == 8)


@query("SELECT c_custkey FROM customer WHERE c_acctbal > 0 AND c_mktsegment = 'BUILDING' AND c_nationkey BETWEEN 5 AND 15")
def node_filter_and(s, d):
    from functools import reduce

    tests = [F.col("c_acctbal") > 0, F.col("c_mktsegment") == "BUILDING", F.col("c_nationkey").between(5, 15)]
    return ad.table(s, d, "customer").where(reduce(lambda x, y: x & y, tests)).select("c_custkey")


@query("SELECT k AS attribute, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS k FROM events) GROUP BY 1")
def attribute_counts(s, d):
    return ad.table(s, d, "events").select(F.explode(F.json_object_keys("props")).alias("attribute")).groupBy("attribute").agg(F.count("*").alias("n"))


@query("SELECT substr(url, 1, 12) || '-' || (length(url) - 12) AS selector, count(*) AS n FROM pages WHERE length(url) >= 12 GROUP BY 1")
def selector_counts(s, d):
    u = F.col("url")
    key = F.concat(F.substring(u, 1, 12), F.lit("-"), (F.char_length(u) - 12).cast("string"))
    return ad.table(s, d, "pages").where(F.char_length(u) >= 12).groupBy(key.alias("selector")).agg(F.count("*").alias("n"))


# --- metrics
@query("SELECT event_type, count(*) AS n, round(min(value), 6) AS lo, round(max(value), 6) AS hi, round(avg(value), 6) AS mean, round(sum(value), 4) AS total, round(var_pop(value), 4) AS variance, round(stddev_pop(value), 4) AS deviation FROM events GROUP BY 1")
def metric_snapshot(s, d):
    v = F.col("value")
    r = F.round
    return ad.table(s, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), r(F.min(v), 6).alias("lo"), r(F.max(v), 6).alias("hi"), r(F.avg(v), 6).alias("mean"), r(F.sum(v), 4).alias("total"), r(F.var_pop(v), 4).alias("variance"), r(F.stddev_pop(v), 4).alias("deviation"))


@query("WITH v AS (SELECT event_type, list_sort(list(value)) AS x, unnest([0.5, 0.75, 0.99]::DOUBLE[]) AS p FROM events GROUP BY event_type), q AS (SELECT *, p * (len(x) + 1) AS pos FROM v) SELECT event_type, p, round(CASE WHEN pos < 1 THEN x[1] WHEN pos >= len(x) THEN x[len(x)] ELSE x[CAST(floor(pos) AS BIGINT)] + (pos - floor(pos)) * (x[CAST(floor(pos) AS BIGINT) + 1] - x[CAST(floor(pos) AS BIGINT)]) END, 6) AS v FROM q")
def percentile_interpolated(s, d):
    return c.percentile_points(ad.table(s, d, "events"), "event_type", "value", (0.5, 0.75, 0.99)).withColumn("v", F.round("v", 6))


@query("WITH h AS (SELECT event_type, floor(value / 10) * 10 AS low, count(*) AS k FROM events GROUP BY ALL), q AS (SELECT *, sum(k) OVER (PARTITION BY event_type ORDER BY low ROWS UNBOUNDED PRECEDING) AS hi, sum(k) OVER (PARTITION BY event_type) AS n FROM h) SELECT event_type, round(sum((low + 5) * k) / max(n), 6) AS mean, min(low) FILTER (hi > 0.5 * n) AS median_edge FROM q GROUP BY 1")
def bucket_hist_stats(s, d):
    from pyspark.sql import Window

    h = ad.table(s, d, "events").groupBy("event_type", (F.floor(F.col("value") / 10) * 10).cast("double").alias("low")).agg(F.count("*").alias("k"))
    by = Window.partitionBy("event_type")
    q = h.withColumn("hi", F.sum("k").over(by.orderBy("low"))).withColumn("n", F.sum("k").over(by))
    return q.groupBy("event_type").agg(F.round(F.sum((F.col("low") + 5) * F.col("k")) / F.max("n"), 6).alias("mean"), F.min(F.when(F.col("hi") > 0.5 * F.col("n"), F.col("low"))).alias("median_edge"))


@query("WITH x AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem), y AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS i FROM x) SELECT l_orderkey, l_linenumber FROM y WHERE i = l_linenumber")
def contiguous_ready(s, d):
    return c.ready(ad.table(s, d, "lineitem"), "l_orderkey", "l_linenumber", 1)


@query("WITH x AS (SELECT CAST(ts AS DATE) AS day, count(*) FILTER (event_type = 'view') AS a, count(*) FILTER (event_type = 'click') AS b FROM events GROUP BY 1) SELECT round(corr(a, b), 6) AS r FROM x")
def category_correlation(s, d):
    x = ad.table(s, d, "events").groupBy(F.to_date("ts")).agg(F.count_if(F.col("event_type") == "view").alias("a"), F.count_if(F.col("event_type") == "click").alias("b"))
    return x.agg(F.round(F.corr("a", "b"), 6).alias("r"))


@query("WITH RECURSIVE t AS (SELECT event_type AS g, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS i, count(*) / 5.0 AS x FROM events GROUP BY ALL), o AS (SELECT g, x, row_number() OVER (PARTITION BY g ORDER BY i) AS n, count(*) OVER (PARTITION BY g) AS k FROM t), e AS (SELECT g, n, k, CAST(x AS DOUBLE) AS rate FROM o WHERE n = 1 UNION ALL SELECT o.g, o.n, o.k, e.rate + (1 - exp(-5.0 / 60)) * (o.x - e.rate) FROM e JOIN o ON o.g = e.g AND o.n = e.n + 1) SELECT g AS event_type, round(rate, 6) AS rate FROM e WHERE n = k")
def ewma_rate(s, d):
    t = ad.table(s, d, "events").groupBy("event_type", F.datediff(F.to_date("ts"), F.lit("2024-01-01")).alias("tick")).agg(F.count("*").alias("k"))
    return c.ewma(t, "event_type", "tick", "k", 5.0, 1.0).withColumn("rate", F.round("rate", 6))


@query()
def reservoir_uniform(s, d):
    return c.uniform_sample(ad.table(s, d, "events").select("event_id", "value"), 100, 11, "event_id")


@query()
def reservoir_decay(s, d):
    e = ad.table(s, d, "events").select("event_id", "ts", "value")
    return c.decaying_sample(e, 100, 11, F.unix_timestamp("ts").cast("double"), 1e-5, "event_id")


# --- streams, drained
@query(SQL["op_count_by_category"])
def stream_op_count(s, d):
    return streams.drained(streams.running_counts(ad.as_trace(streams.read(s, f"{d}/events.parquet"))), "complete")


@query(f"WITH {TRACE} SELECT seq, key FROM trace WHERE category = 'CodePrefix' AND op_type = 'Get'")
def stream_log_filter(s, d):
    t = ad.as_trace(streams.read(s, f"{d}/events.parquet"))
    return streams.drained(t.where("category = 'CodePrefix' AND op_type = 'Get'").select("seq", "key"))


@query(f"WITH {TRACE} SELECT DISTINCT key FROM trace WHERE op_type IN ('Put', 'BatchPut')")
def stream_first_writes(s, d):
    return streams.drained(streams.first_writes(ad.as_trace(streams.read(s, f"{d}/events.parquet"))).select("key"))


@query(f"WITH {TRACE}, x AS (SELECT block_id AS segment_id, seq, key, lag(key, 2) OVER (PARTITION BY block_id ORDER BY seq) AS o FROM trace WHERE op_type = 'Get') SELECT segment_id, seq, least(key, o) AS k1, greatest(key, o) AS k2 FROM x WHERE o IS NOT NULL")
def stream_read_pairs(s, d):
    t = ad.as_trace(streams.read(s, f"{d}/events.parquet")).where("op_type = 'Get'")
    return streams.drained(streams.pairs(t.select("segment_id", "seq", "key"), 1))


@query("SELECT l_orderkey // 100 // 8 AS section, count(*) AS n FROM lineitem WHERE l_orderkey // 100 // 8 < ((SELECT max(l_orderkey // 100) FROM lineitem) + 1 - 4) // 8 GROUP BY 1")
def confirmed_sections(s, d):
    head = ad.logs(s, d).agg(F.max("block_number")).first()[0] or 0
    return streams.confirmed(ad.logs(s, d), head, 4, 8).groupBy("section").agg(F.count("*").alias("n"))


@query("SELECT event_type, CAST(sum(CASE WHEN event_id % 3 = 0 THEN -1 ELSE 1 END) AS BIGINT) AS n FROM events GROUP BY 1")
def signed_log_counts(s, d):
    return streams.signed_counts(ad.table(s, d, "events").withColumn("removed", F.col("event_id") % 3 == 0), "event_type")


# --- bloom index, networks, pools
def log_blooms(s, d):
    from marlstone.operators import bloom

    x = ad.logs(s, d).select("block_number", F.concat(F.lit("a"), F.col("address").cast("string")).cast("binary").alias("a"), F.concat(F.lit("t"), F.get("topics", F.lit(0))).cast("binary").alias("t"))
    return bloom.set_bits(x, ["a", "t"])


def log_bloom_matches(s, d):
    """Logs of address 3 or 4 and topic R, read from blocks that an index of all logs names."""
    from marlstone.operators import bloom

    near = bloom.candidates(bloom.index(log_blooms(s, d), 16), [[b"a3", b"a4"], [b"tR"]], 16)
    return c.log_filter(ad.logs(s, d).join(near, "block_number", "left_semi"), addresses=(3, 4), topics=(("R",),)).select(*LOG_COLUMNS)


@query(f"WITH {LOGS} SELECT block_number, tx_hash, pos, address, data FROM logs WHERE address IN (3, 4) AND t0 = 'R'")
def log_filter_bloom_index(s, d):
    return log_bloom_matches(s, d)


@query("SELECT user_id, '10.' || user_id % 7 || '.' || user_id % 3 || '.9' AS ip FROM (SELECT DISTINCT user_id FROM events) WHERE user_id % 7 BETWEEN 4 AND 5")
def node_filter_network(s, d):
    from marlstone.functions.codecs import in_network

    u = F.col("user_id")
    ip = F.concat(F.lit("10."), (u % 7).cast("string"), F.lit("."), (u % 3).cast("string"), F.lit(".9"))
    return ad.table(s, d, "events").select("user_id", ip.alias("ip")).distinct().where(in_network(F.col("ip"), "10.4.0.0/15"))


@query(f"WITH {TXS}, p AS (SELECT sender AS account, tx_hash AS nonce, reward, min(CASE WHEN reward > 150000 THEN tx_hash END) OVER (PARTITION BY sender) AS low FROM txs) SELECT account, nonce FROM p WHERE low IS NULL OR nonce < low")
def pool_filter_strict(s, d):
    from marlstone.operators import pool

    p = ad.txs(s, d).select(F.col("sender").alias("account"), F.col("tx_hash").alias("nonce"), "reward")
    return pool.drop_costly(p, F.col("reward") > 150_000).select("account", "nonce")


@query(f"WITH {TXS} SELECT sender AS tx, CAST(max(gas_used % 4) AS BIGINT) AS deepest, count(*) AS steps FROM txs GROUP BY 1")
def tracer_depths(s, d):
    from marlstone.operators import pool

    steps = ad.txs(s, d).select(F.col("sender").alias("tx"), F.col("tx_hash").alias("seq"), (F.col("gas_used") % 4).alias("depth"))
    return pool.run_tracer("depths", steps)


@query(f"WITH {TXS}, c AS (SELECT sender AS tx, tx_hash AS seq, gas_used % 4 AS depth FROM txs) SELECT tx, seq, CASE WHEN depth > 0 THEN (SELECT max(p.seq) FROM c p WHERE p.tx = c.tx AND p.seq < c.seq AND p.depth = c.depth - 1) END AS parent FROM c")
def call_tree_parents(s, d):
    from marlstone.operators import pool

    calls = ad.txs(s, d).select(F.col("sender").alias("tx"), F.col("tx_hash").alias("seq"), (F.col("gas_used") % 4).cast("int").alias("depth"))
    return pool.call_parents(calls).select("tx", "seq", "parent")
