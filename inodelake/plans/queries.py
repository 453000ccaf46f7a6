"""The registered queries over the driver's tables, each beside the SQL it is held against.

Stand-ins: documents are files (content: UTF-8 of the text), region, nation and
customer are a tree, orders a bitmap, conversations append logs, page urls paths.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inodelake import layout
from inodelake.functions import codec
from inodelake.operators import bitmap, content, tree
from inodelake.runtime import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

BITS_SQL = "bits AS (SELECT o_orderkey AS bit_index, o_orderstatus = 'F' AS used FROM orders)"


def query(sql: str) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def bits(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("bit_index"), (F.col("o_orderstatus") == "F").alias("used"))


def files(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("file_id"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))


def dirents(spark: SparkSession, sf: str) -> DataFrame:
    """region / nation / customer as directories and files."""
    of = lambda mark, key: F.concat(F.lit(mark), F.col(key).cast("string"))
    region = table(spark, sf, "region").select(F.lit("root").alias("parent_id"), F.col("r_regionkey").cast("long").alias("slot"), of("r", "r_regionkey").alias("inode_id"), F.col("r_name").alias("name"), F.lit("d").alias("kind"))
    nation = table(spark, sf, "nation").select(of("r", "n_regionkey"), F.col("n_nationkey").cast("long"), of("n", "n_nationkey"), "n_name", F.lit("d"))
    customer = table(spark, sf, "customer").select(of("n", "c_nationkey"), F.col("c_custkey").cast("long"), of("c", "c_custkey"), "c_name", F.lit("f"))
    return region.union(nation).union(customer)


DIRENTS_SQL = """dirents AS (
  SELECT 'root' AS parent_id, r_regionkey::BIGINT AS slot, 'r' || r_regionkey AS inode_id, r_name AS name, 'd' AS kind FROM region
  UNION ALL SELECT 'r' || n_regionkey, n_nationkey, 'n' || n_nationkey, n_name, 'd' FROM nation
  UNION ALL SELECT 'n' || c_nationkey, c_custkey, 'c' || c_custkey, c_name, 'f' FROM customer)"""


RUNS_SQL = f"""{BITS_SQL}, runs AS (
  SELECT min(bit_index) AS run_start, count(*) AS run_length
  FROM (SELECT bit_index, bit_index - row_number() OVER (ORDER BY bit_index) AS run FROM bits WHERE NOT used) GROUP BY run)"""


STATS_SQL = f"""WITH {RUNS_SQL}, counts AS (SELECT count(*) AS total, count(*) FILTER (used) AS used FROM bits),
r AS (SELECT count(*) AS runs, coalesce(max(run_length), 0)::BIGINT AS largest, coalesce(avg(run_length), 0.0)::DOUBLE AS gap FROM runs),
stats AS (SELECT total AS total_blocks, used AS used_blocks, total - used AS free_blocks, runs AS free_runs, largest AS largest_free_run, gap AS avg_gap_size,
       CASE WHEN total > used AND runs > 1 THEN (runs - 1)::DOUBLE / greatest(total - used - 1, 1) ELSE 0.0 END AS fragmentation_ratio FROM counts, r)"""


@query(f"{STATS_SQL} SELECT * FROM stats")
def frag_stats(spark: SparkSession, sf: str) -> DataFrame:
    return bitmap.frag_stats(bits(spark, sf))


@query(f"WITH {RUNS_SQL} SELECT run_start, run_length FROM runs")
def free_runs(spark: SparkSession, sf: str) -> DataFrame:
    return bitmap.free_runs(bits(spark, sf))


@query(f"WITH {BITS_SQL} SELECT min(bit_index) AS first_free FROM bits WHERE NOT used")
def first_free(spark: SparkSession, sf: str) -> DataFrame:
    return bitmap.first_free(bits(spark, sf))


@query(f"""WITH {BITS_SQL}, units AS (
  SELECT request_id, unnest(range(n)) AS nth FROM (SELECT doc_id AS request_id, (strlen(coalesce(text, '')) + {layout.BLOCK - 1}) // {layout.BLOCK} AS n FROM documents)
), turns AS (SELECT *, row_number() OVER (ORDER BY request_id, nth) AS turn FROM units),
free AS (SELECT bit_index, row_number() OVER (ORDER BY bit_index) AS turn FROM bits WHERE NOT used)
SELECT request_id, nth, bit_index FROM turns LEFT JOIN free USING (turn)""")
def alloc_first_fit(spark: SparkSession, sf: str) -> DataFrame:
    wanted = files(spark, sf).select(F.col("file_id").alias("request_id"), bitmap.blocks_of(F.octet_length("content")).alias("n_blocks"))
    return bitmap.allocate_first_fit(bits(spark, sf), wanted)


@query(f"""WITH {BITS_SQL}, freed AS (SELECT DISTINCT doc_id FROM labels WHERE doc_id >= 3)
SELECT bit_index, used AND doc_id IS NULL AS used FROM bits LEFT JOIN freed ON bit_index = doc_id""")
def free_blocks_batch(spark: SparkSession, sf: str) -> DataFrame:
    return bitmap.free_bits(bits(spark, sf), table(spark, sf, "labels").select(F.col("doc_id").alias("bit_index")), 3)


@query(f"WITH {BITS_SQL} SELECT bit_index, bit_index // 8 AS byte_index, (bit_index % 8)::INTEGER AS bit_in_byte, (1 << (bit_index % 8)::INTEGER)::INTEGER AS mask, used FROM bits")
def bit_address(spark: SparkSession, sf: str) -> DataFrame:
    return bitmap.bit_address(bits(spark, sf))


@query(f"""WITH f AS (SELECT doc_id AS file_id, (strlen(text) + {layout.BLOCK - 1}) // {layout.BLOCK} AS n_blocks FROM documents WHERE strlen(text) > 0)
SELECT file_id, n_blocks, (sum(n_blocks) OVER (ORDER BY file_id) - n_blocks + {layout.DATA_START})::BIGINT AS new_first_block FROM f""")
def defrag_layout(spark: SparkSession, sf: str) -> DataFrame:
    return bitmap.contiguous_layout(files(spark, sf).select("file_id", F.octet_length("content").alias("size")))


@query(f"""WITH f AS (SELECT doc_id AS file_id, encode(coalesce(text, '')) AS content FROM documents),
c AS (SELECT file_id, content, unnest(range((octet_length(content) + {layout.BLOCK - 1}) // {layout.BLOCK})) AS n FROM f)
SELECT file_id, n::INTEGER AS chunk_no, octet_length(content[n * {layout.BLOCK} + 1:(n + 1) * {layout.BLOCK}])::INTEGER AS n_bytes, sha256(content[n * {layout.BLOCK} + 1:(n + 1) * {layout.BLOCK}]) AS digest FROM c""")
def block_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return content.chunks(files(spark, sf)).select("file_id", "chunk_no", F.octet_length("data").alias("n_bytes"), F.sha2("data", 256).alias("digest"))


@query("SELECT doc_id AS file_id, strlen(text)::INTEGER AS n_bytes, sha256(text) AS digest FROM documents WHERE strlen(text) > 0")
def reassemble(spark: SparkSession, sf: str) -> DataFrame:
    whole = content.reassembled(content.chunks(files(spark, sf)))
    return whole.select("file_id", F.octet_length("content").alias("n_bytes"), F.sha2("content", 256).alias("digest"))


@query(f"SELECT doc_id AS file_id, strlen(coalesce(text, ''))::INTEGER AS logical_size, strlen(coalesce(text, '')) >= {layout.COMPRESS_FROM} AS tried FROM documents")
def compress_gate(spark: SparkSession, sf: str) -> DataFrame:
    size = F.octet_length("content")
    return files(spark, sf).select("file_id", size.alias("logical_size"), (size >= layout.COMPRESS_FROM).alias("tried"))


@query(f"""SELECT doc_id AS file_id, strlen(coalesce(text, ''))::INTEGER AS logical_size, sha256(coalesce(text, '')) AS digest,
       strlen(coalesce(text, '')) >= {layout.COMPRESS_FROM} AS smaller FROM documents""")
def compress_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    packed = files(spark, sf).withColumn("packed", codec.zstd_encode("content"))
    packed = packed.select("file_id", F.octet_length("content").alias("logical_size"), codec.stored(F.col("content"), F.col("packed"), F.lit("auto")).alias("stored"), "packed")
    small = F.octet_length("stored") < F.col("logical_size")
    return packed.select("file_id", "logical_size", F.sha2(codec.zstd_decode("packed"), 256).alias("digest"), small.alias("smaller"))


@query(f"""SELECT doc_id AS file_id, strlen(coalesce(text, ''))::INTEGER AS logical_size, (strlen(coalesce(text, '')) + {codec.OVERHEAD})::INTEGER AS physical_size,
       sha256(coalesce(text, '')) AS digest, true AS wrong_key_fails FROM documents""")
def encrypt_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    key, wrong = (codec.derive_key(p, b"0123456789abcdef") for p in ("secret", "other"))
    sealed = files(spark, sf).select("file_id", F.octet_length("content").alias("logical_size"), codec.encrypt(F.col("content"), key).alias("sealed"))
    return sealed.select("file_id", "logical_size", F.octet_length("sealed").alias("physical_size"), F.sha2(codec.decrypt(F.col("sealed"), key), 256).alias("digest"), codec.decrypt(F.col("sealed"), wrong).isNull().alias("wrong_key_fails"))


@query("SELECT p_brand AS parent_id, p_type AS name, min(p_partkey) AS inode_id, count(*) AS entries FROM part GROUP BY ALL")
def lookup_first(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part").select(F.col("p_brand").alias("parent_id"), F.col("p_type").alias("name"), F.col("p_partkey").alias("inode_id"), F.col("p_partkey").alias("slot"))
    return tree.lookup_first(part)


INODES_SQL = """inodes AS (
  SELECT 'r' || r_regionkey AS inode_id, 4096::BIGINT AS size, 0::BIGINT AS compressed_size, 1600000000 + r_regionkey::BIGINT AS modified_at FROM region
  UNION ALL SELECT 'n' || n_nationkey, 4096, 0, 1600000000 + n_nationkey * 86400 FROM nation
  UNION ALL SELECT 'c' || c_custkey, floor(greatest(c_acctbal, 0))::BIGINT, CASE WHEN c_custkey % 3 = 0 THEN floor(greatest(c_acctbal, 0))::BIGINT // 2 ELSE 0 END, 1600000000 + c_custkey * 3601 FROM customer)"""
LONG_SQL = "size, nullif(compressed_size, 0) AS comp_size, strftime(make_timestamp(modified_at * 1000000), '%Y-%m-%d %H:%M:%S') AS modified"


def inodes(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes and times of what ``dirents`` names; every third customer is compressed."""
    of = lambda mark, key: F.concat(F.lit(mark), F.col(key).cast("string")).alias("inode_id")
    full = F.lit(4096).cast("long").alias("size")
    none = F.lit(0).cast("long").alias("compressed_size")
    at = lambda key, step: (F.lit(1_600_000_000).cast("long") + F.col(key) * step).alias("modified_at")
    size = F.floor(F.greatest("c_acctbal", F.lit(0.0))).cast("long")
    packed = F.when(F.col("c_custkey") % 3 == 0, F.floor(size / 2)).otherwise(0).cast("long")
    rows = table(spark, sf, "region").select(of("r", "r_regionkey"), full, none, at("r_regionkey", 1))
    rows = rows.union(table(spark, sf, "nation").select(of("n", "n_nationkey"), full, none, at("n_nationkey", 86400)))
    return rows.union(table(spark, sf, "customer").select(of("c", "c_custkey"), size, packed, at("c_custkey", 3601)))


@query(f"WITH {DIRENTS_SQL}, {INODES_SQL} SELECT parent_id, slot, name, kind, size FROM dirents JOIN inodes USING (inode_id)")
def list_dir(spark: SparkSession, sf: str) -> DataFrame:
    return tree.list_directory(dirents(spark, sf), inodes(spark, sf))


@query(f"""WITH RECURSIVE {DIRENTS_SQL}, {INODES_SQL}, w AS (
  SELECT name, inode_id, kind FROM dirents WHERE parent_id = 'root'
  UNION ALL SELECT w.name || '/' || d.name, d.inode_id, d.kind FROM dirents d JOIN w ON d.parent_id = w.inode_id)
SELECT '' AS target, name, kind, {LONG_SQL} FROM w JOIN inodes USING (inode_id)""")
def list_long(spark: SparkSession, sf: str) -> DataFrame:
    return tree.listing(dirents(spark, sf), inodes(spark, sf), spark.createDataFrame([("/",)], "path string"), "root", recursive=True)


#: Paths that are asked for: a directory, a file, a missing name, and something below a file.
ASKED_SQL = """asked AS (
  SELECT r_name || '/' || n_name AS path, 'n' || n_nationkey AS inode_id, 'd' AS kind, 'ok' AS outcome FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT r_name || '/' || n_name || '/' || c_name || CASE c_custkey % 3 WHEN 1 THEN '/deeper' WHEN 2 THEN '.none' ELSE '' END,
         CASE WHEN c_custkey % 3 = 0 THEN 'c' || c_custkey END, CASE WHEN c_custkey % 3 = 0 THEN 'f' END, CASE c_custkey % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'not a directory' ELSE 'not found' END
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def asked(spark: SparkSession, sf: str) -> DataFrame:
    tops = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    key = F.col("c_custkey") % 3
    below = table(spark, sf, "customer").join(tops, F.col("c_nationkey") == F.col("n_nationkey"))
    end = F.when(key == 1, "/deeper").when(key == 2, ".none").otherwise("")
    return tops.select(F.concat_ws("/", "r_name", "n_name").alias("path")).union(below.select(F.concat(F.concat_ws("/", "r_name", "n_name", "c_name"), end)))


@query(f"WITH {ASKED_SQL} SELECT * FROM asked")
def path_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return tree.outcomes(asked(spark, sf), dirents(spark, sf), "root")


@query(f"""WITH {ASKED_SQL}, {DIRENTS_SQL}, {INODES_SQL}, rows AS (
  SELECT a.path AS target, a.path || '/' || d.name AS name, d.inode_id, d.kind FROM asked a JOIN dirents d ON d.parent_id = a.inode_id WHERE a.kind = 'd'
  UNION ALL SELECT path, path, inode_id, kind FROM asked WHERE kind = 'f')
SELECT target, name, kind, {LONG_SQL} FROM rows JOIN inodes USING (inode_id)""")
def list_targets(spark: SparkSession, sf: str) -> DataFrame:
    return tree.listing(dirents(spark, sf), inodes(spark, sf), asked(spark, sf), "root")


@query(f"""WITH {DIRENTS_SQL}, requests AS (
  SELECT parent_id, CASE WHEN slot % 5 = 4 THEN name || '?' ELSE name END AS name, inode_id, slot FROM dirents WHERE kind = 'd' OR slot % 2 = 0)
SELECT parent_id, name, CASE WHEN slot % 5 <> 4 THEN inode_id END AS inode_id,
       CASE WHEN slot % 5 = 4 THEN 'not found' WHEN inode_id IN (SELECT parent_id FROM dirents) THEN 'not empty' ELSE 'deleted' END AS outcome FROM requests""")
def delete_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    wrong = F.when(F.col("slot") % 5 == 4, F.concat("name", F.lit("?"))).otherwise(F.col("name"))
    entries = dirents(spark, sf)
    return tree.delete(entries, entries.where("kind = 'd' or slot % 2 = 0").select("parent_id", wrong.alias("name")))


@query(f"""WITH RECURSIVE {DIRENTS_SQL}, w AS (
  SELECT name AS path, inode_id, kind, 1 AS depth, slot::VARCHAR AS slots FROM dirents WHERE parent_id = 'root'
  UNION ALL SELECT w.path || '/' || d.name, d.inode_id, d.kind, depth + 1, slots || '/' || d.slot FROM dirents d JOIN w ON d.parent_id = w.inode_id)
SELECT path, inode_id, kind, depth, slots FROM w""")
def list_recursive(spark: SparkSession, sf: str) -> DataFrame:
    found = tree.walk(dirents(spark, sf), "root")
    return found.withColumn("slots", F.array_join(F.col("slots").cast("array<string>"), "/"))


@query("""SELECT '/' || r_name || '//./' || n_name || CASE WHEN n_nationkey % 5 = 0 THEN '/none' ELSE '' END AS path, CASE WHEN n_nationkey % 5 <> 0 THEN 'n' || n_nationkey END AS inode_id
FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT r_name || '/' || n_name || '/' || c_name, 'c' || c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def resolve_path(spark: SparkSession, sf: str) -> DataFrame:
    region, nation, customer = (table(spark, sf, t) for t in ("region", "nation", "customer"))
    tops = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    missing = F.when(F.col("n_nationkey") % 5 == 0, "/none").otherwise("")
    paths = tops.select(F.concat(F.lit("/"), "r_name", F.lit("//./"), "n_name", missing).alias("path"))
    paths = paths.union(customer.join(tops, F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat_ws("/", "r_name", "n_name", "c_name")))
    return tree.resolve(paths, dirents(spark, sf), "root")


PARTS_SQL = "p AS (SELECT page_id, list_filter(string_split(url, '/'), lambda x: x <> '' AND x <> '.') AS parts FROM pages)"


@query(f"WITH {PARTS_SQL} SELECT page_id, CASE WHEN len(parts) > 0 THEN array_to_string(parts[1:len(parts) - 1], '/') END AS parent, parts[len(parts)] AS name FROM p")
def resolve_parent(spark: SparkSession, sf: str) -> DataFrame:
    parent, name = tree.parent_and_name(F.col("url"))
    return table(spark, sf, "pages").select("page_id", parent.alias("parent"), name.alias("name"))


@query(f"WITH {PARTS_SQL} SELECT page_id, len(parts)::INTEGER AS n_parts, array_to_string(parts, '/') AS path FROM p")
def path_split(spark: SparkSession, sf: str) -> DataFrame:
    parts = tree.path_parts(F.col("url"))
    return table(spark, sf, "pages").select("page_id", F.size(parts).alias("n_parts"), F.array_join(parts, "/").alias("path"))


@query(f"""WITH e AS (SELECT lang AS parent_id, doc_id AS slot, strlen('doc' || doc_id || '.txt') + {layout.ENTRY_HEAD} AS bytes FROM documents),
u AS (SELECT *, sum(bytes) OVER (PARTITION BY parent_id ORDER BY slot ROWS UNBOUNDED PRECEDING) AS upto FROM e)
SELECT parent_id, count(*) AS entries, count(*) FILTER (upto <= {layout.BLOCK}) AS fitting, coalesce(max(upto) FILTER (upto <= {layout.BLOCK}), 0)::BIGINT AS bytes_used FROM u GROUP BY parent_id""")
def dir_capacity(spark: SparkSession, sf: str) -> DataFrame:
    return tree.capacity(table(spark, sf, "documents").select(F.col("lang").alias("parent_id"), F.col("doc_id").alias("slot"), F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("name")))


@query("""WITH l AS (SELECT conv_id AS file_id, turn AS seq, CASE WHEN ends_with(coalesce(text, ''), chr(10)) THEN text ELSE coalesce(text, '') || chr(10) END AS line FROM conversations)
SELECT file_id, count(*) AS lines, strlen(string_agg(line, '' ORDER BY seq, line))::INTEGER AS n_bytes, sha256(string_agg(line, '' ORDER BY seq, line)) AS digest FROM l GROUP BY file_id""")
def append_log(spark: SparkSession, sf: str) -> DataFrame:
    said = table(spark, sf, "conversations").select(F.col("conv_id").alias("file_id"), F.col("turn").alias("seq"), F.col("text").alias("line"))
    counts = said.groupBy(F.col("file_id").alias("of")).agg(F.count(F.lit(1)).alias("lines"))
    whole = content.appended(said)
    return whole.join(counts, F.col("file_id").eqNullSafe(F.col("of"))).select("file_id", "lines", F.octet_length("content").alias("n_bytes"), F.sha2("content", 256).alias("digest"))


@query("SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def upsert_latest(spark: SparkSession, sf: str) -> DataFrame:
    return content.latest(table(spark, sf, "events").select("user_id", "event_id", "event_type", "value", "ts"), "user_id", ["ts", "event_id"]).drop("ts")


@query(f"""WITH f AS (SELECT source, doc_id, (strlen(coalesce(text, '')) + {layout.BLOCK - 1}) // {layout.BLOCK} AS n FROM documents),
g AS (SELECT *, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS gone FROM f)
SELECT source, count(*) AS entries_before, count(*) FILTER (NOT gone) AS entries_after, coalesce(sum(n) FILTER (gone), 0)::BIGINT AS freed_blocks FROM g GROUP BY source""")
def delete_entries(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("source", "doc_id", bitmap.blocks_of(F.coalesce(F.octet_length("text"), F.lit(0))).alias("n"))
    left = content.without(docs, table(spark, sf, "labels").where("toxic = 1").select("doc_id"), "doc_id")
    before = docs.groupBy("source").agg(F.count(F.lit(1)).alias("entries_before"), F.sum("n").alias("all"))
    after = left.groupBy("source").agg(F.count(F.lit(1)).alias("entries_after"), F.sum("n").alias("kept"))
    return before.join(after, "source", "left").select("source", "entries_before", F.coalesce("entries_after", F.lit(0)).alias("entries_after"), (F.col("all") - F.coalesce("kept", F.lit(0))).alias("freed_blocks"))


@query(f"""WITH {DIRENTS_SQL}, requests AS (
  SELECT 'n' || c_nationkey AS parent_id, 'd' || (c_custkey + 1000000) AS inode_id, 'f' AS kind, c_custkey,
         CASE c_custkey % 5 WHEN 0 THEN c_name WHEN 1 THEN repeat('x', 256) WHEN 2 THEN 'a/' || c_name ELSE 'new ' || c_name END AS name FROM customer
  UNION ALL SELECT 'empty', 'e' || n_nationkey, 'd', n_nationkey, n_name FROM nation
), fit AS (
  SELECT * FROM requests WHERE strlen(name) <= {layout.NAME_BYTES} AND NOT contains(name, '/') AND (parent_id, name) NOT IN (SELECT (parent_id, name) FROM dirents)
), last AS (SELECT parent_id, max(slot) AS last FROM dirents GROUP BY parent_id)
SELECT f.parent_id, coalesce(last + 1, 0) + row_number() OVER (PARTITION BY f.parent_id ORDER BY f.inode_id) - 1 AS slot, f.inode_id, name, kind FROM fit f LEFT JOIN last l USING (parent_id)""")
def create_entries(spark: SparkSession, sf: str) -> DataFrame:
    turn = F.col("c_custkey") % 5
    name = F.when(turn == 0, F.col("c_name")).when(turn == 1, F.repeat(F.lit("x"), F.lit(256))).when(turn == 2, F.concat(F.lit("a/"), "c_name")).otherwise(F.concat(F.lit("new "), "c_name"))
    files = table(spark, sf, "customer").select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("parent_id"), name.alias("name"), F.concat(F.lit("d"), (F.col("c_custkey") + 1_000_000).cast("string")).alias("inode_id"), F.lit("f").alias("kind"))
    dirs = table(spark, sf, "nation").select(F.lit("empty"), "n_name", F.concat(F.lit("e"), F.col("n_nationkey").cast("string")), F.lit("d"))
    return tree.create_entries(dirents(spark, sf), files.union(dirs))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS modified FROM orders")
def mtime_format(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", F.date_format(F.timestamp_seconds(F.unix_timestamp("o_orderdate")), "yyyy-MM-dd HH:mm:ss").alias("modified"))


@query("""WITH h AS (SELECT o_orderkey * 1000003 + o_custkey AS v, printf('%016X', o_orderkey * 1000003 + o_custkey) AS x, o_orderkey FROM orders)
SELECT o_orderkey, x[15:16] || x[13:14] || x[11:12] || x[9:10] || x[7:8] || x[5:6] || x[3:4] || x[1:2] AS encoded, v AS decoded FROM h""")
def le_codec(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select("o_orderkey", codec.to_little_endian(F.col("o_orderkey") * 1000003 + F.col("o_custkey")).alias("data"))
    return rows.select("o_orderkey", F.hex("data").alias("encoded"), codec.from_little_endian(F.col("data")).alias("decoded"))


@query(f"""WITH i AS (SELECT p_partkey AS image_id, p_size * 256::BIGINT AS n FROM part)
SELECT image_id, {layout.MAGIC}::BIGINT AS magic, {layout.BLOCK}::BIGINT AS block_size, n AS block_count, 1::BIGINT AS inode_bitmap_block, 2::BIGINT AS data_bitmap_block, 3::BIGINT AS inode_table_block,
       {layout.INODES}::BIGINT AS inode_count, {layout.DATA_START}::BIGINT AS data_block_start, greatest(n - {layout.DATA_START}, 0)::BIGINT AS data_blocks,
       least(greatest(n - {layout.DATA_START}, 0), {layout.BITS})::BIGINT AS allocatable_blocks, n > {layout.DATA_START} AS valid FROM i""")
def superblock_layout(spark: SparkSession, sf: str) -> DataFrame:
    return bitmap.superblock_layout(table(spark, sf, "part").select(F.col("p_partkey").alias("image_id"), (F.col("p_size").cast("long") * 256).alias("total_blocks")))


@query("SELECT doc_id AS file_id, true AS valid, strlen(text)::INTEGER AS n_bytes, length(text)::INTEGER AS n_chars FROM documents")
def utf8_check(spark: SparkSession, sf: str) -> DataFrame:
    text = F.try_validate_utf8(F.col("text"))
    return table(spark, sf, "documents").select(F.col("doc_id").alias("file_id"), text.isNotNull().alias("valid"), F.octet_length(text).alias("n_bytes"), F.length(text).alias("n_chars"))


@query(f"""{STATS_SQL} SELECT '{{"total_blocks":' || total_blocks || ',"used_blocks":' || used_blocks || ',"free_runs":' || free_runs || ',"largest_free_run":' || largest_free_run
       || ',"fragmentation":"' || printf('%.3f', fragmentation_ratio) || '"}}' AS status FROM stats""")
def status_json(spark: SparkSession, sf: str) -> DataFrame:
    row = F.struct("total_blocks", "used_blocks", "free_runs", "largest_free_run", F.format_string("%.3f", "fragmentation_ratio").alias("fragmentation"))
    return bitmap.frag_stats(bits(spark, sf)).select(F.to_json(row).alias("status"))


@query(f"""{STATS_SQL} SELECT total_blocks * 4 AS total_kb, used_blocks * 4 AS used_kb, free_blocks * 4 AS free_kb, largest_free_run * 4 AS largest_free_kb,
       printf('%.2f', avg_gap_size) AS avg_gap, printf('%.2f%%', fragmentation_ratio * 100) AS fragmentation FROM stats""")
def analyze_report(spark: SparkSession, sf: str) -> DataFrame:
    return bitmap.size_report(bitmap.frag_stats(bits(spark, sf)))


@query(f"""{STATS_SQL}, moved AS (SELECT count(*) AS files_processed, coalesce(sum(strlen(text)), 0)::BIGINT AS bytes_moved FROM documents WHERE strlen(text) > 0 AND lang <> 'es')
SELECT files_processed, bytes_moved, greatest(free_runs - CASE WHEN free_blocks > 0 THEN 1 ELSE 0 END, 0)::BIGINT AS blocks_freed, fragmentation_ratio AS frag_before, 0.0::DOUBLE AS frag_after FROM moved, stats""")
def defrag_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Documents in Spanish stand for directories."""
    kind = F.when(F.col("lang") == "es", "d").otherwise("f")
    sized = table(spark, sf, "documents").select(F.col("doc_id").alias("file_id"), kind.alias("kind"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size"))
    return bitmap.defrag_stats(bits(spark, sf), sized)


@query(f"SELECT doc_id AS file_id, (strlen(coalesce(text, '')) + {layout.BLOCK - 1}) // {layout.BLOCK} AS n_blocks, strlen(coalesce(text, ''))::INTEGER AS n_bytes, sha256(coalesce(text, '')) AS digest FROM documents")
def read_by_pointers(spark: SparkSession, sf: str) -> DataFrame:
    """Files laid out in blocks, and read again through the pointers of their inodes."""
    nodes, data = content.stored_blocks(files(spark, sf))
    counts = nodes.select(F.col("file_id").alias("of"), F.size("blocks").cast("long").alias("n_blocks"))
    whole = content.read_files(nodes, data).join(counts, F.col("file_id") == F.col("of"))
    return whole.select("file_id", "n_blocks", F.octet_length("content").alias("n_bytes"), F.sha2("content", 256).alias("digest"))


@query("""SELECT doc_id AS file_id, CASE WHEN doc_id % 3 <> 0 THEN length(text)::INTEGER END AS n_chars, CASE WHEN doc_id % 3 <> 0 THEN sha256(text) END AS digest,
       CASE WHEN doc_id % 3 = 0 THEN 'non-UTF-8 data' END AS error FROM documents""")
def read_text(spark: SparkSession, sf: str) -> DataFrame:
    """Every third file gets a byte that UTF-8 doesn't have, or half a character."""
    bad = F.when(F.col("file_id") % 2 == 0, F.lit(b"\xff")).otherwise(F.lit(b"\xc3"))
    some = files(spark, sf).withColumn("content", F.when(F.col("file_id") % 3 == 0, F.concat("content", bad)).otherwise(F.col("content")))
    return content.as_text(some).select("file_id", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("digest"), "error")


@query(f"""WITH m AS (SELECT doc_id AS file_id, ['auto', 'always', 'never'][doc_id % 3 + 1] AS mode, doc_id % 4 = 0 AS noise,
       CASE WHEN doc_id % 4 = 0 THEN 9600 ELSE strlen(coalesce(text, '')) END AS n FROM documents)
SELECT file_id, mode, n::INTEGER AS logical_size, mode = 'always' OR mode = 'auto' AND NOT noise AND n >= {layout.COMPRESS_FROM} AS compressed, true AS restored FROM m""")
def compress_policy(spark: SparkSession, sf: str) -> DataFrame:
    """The three modes; every fourth file is noise that doesn't shrink."""
    key = F.col("file_id")
    noise = F.unhex(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(300)), lambda k: F.sha2(F.concat_ws(" ", key.cast("string"), k.cast("string")), 256)), ""))
    mode = F.when(key % 3 == 0, "auto").when(key % 3 == 1, "always").otherwise("never")
    some = files(spark, sf).select("file_id", mode.alias("mode"), F.when(key % 4 == 0, noise).otherwise(F.col("content")).alias("content"))
    packed = some.withColumn("packed", codec.zstd_encode("content"))
    kept = packed.withColumn("stored", codec.stored(F.col("content"), F.col("packed"), F.col("mode")))
    compressed = F.sha2("stored", 256) == F.sha2("packed", 256)
    back = F.when(compressed, codec.zstd_decode(F.when(compressed, F.col("packed")))).otherwise(F.col("stored"))
    return kept.select("file_id", "mode", F.octet_length("content").alias("logical_size"), compressed.alias("compressed"), (F.sha2(back, 256) == F.sha2("content", 256)).alias("restored"))


@query("""WITH l AS (SELECT conv_id AS file_id, turn AS seq, CASE WHEN ends_with(coalesce(text, ''), chr(10)) THEN text ELSE coalesce(text, '') || chr(10) END AS line FROM conversations)
SELECT file_id, seq, (sum(strlen(line)) OVER (PARTITION BY file_id ORDER BY seq, line ROWS UNBOUNDED PRECEDING) - strlen(line))::BIGINT AS start, strlen(line)::BIGINT AS n_bytes, sha256(line) AS digest FROM l""")
def append_places(spark: SparkSession, sf: str) -> DataFrame:
    said = table(spark, sf, "conversations").select(F.col("conv_id").alias("file_id"), F.col("turn").alias("seq"), F.col("text").alias("line"))
    return content.append_places(said).select("file_id", "seq", "start", "n_bytes", F.sha2("line", 256).alias("digest"))
