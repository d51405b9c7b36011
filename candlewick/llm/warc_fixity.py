"""Merkle fixity audit of WARC replicas.

Records are hashed; the records whose offsets lie in one fixed range of a file
form a leaf, ``fanout`` neighbouring nodes form a node of the next level, up to
one root a file.  A node's hash is the SHA-256 of its children in offset order,
so equal roots prove equal files.  Two replicas are compared root by root, then
only the children of mismatching nodes are compared, level by level, down to
the records of mismatching leaves, whose differences are the result.

All steps are DataFrame expressions.  A leaf holds the distinct records that
start in ``leaf_bytes`` of a file; equal rows are counted before they are
gathered, and records without an offset are dealt to leaves of their own by the
hash of their id, about ``SPREAD`` a leaf.  A group holds a leaf or ``fanout``
nodes; it can only be larger where different records share one offset, or
neither offset nor id.

Input rows: file, offset, record_id, payload (binary).  Output: file, offset,
record_id, length_a, length_b, status (changed, missing: only in a, extra: only
in b), leaf.

Defined cases: a null payload hashes as a value of its own; null files form one
file; null offsets count as offset -1 (and leaf -1 in the result); repeated rows are
numbered in order of their hash, so a lost copy shows as missing; a file that
only one replica has is all missing or extra; empty tables give no rows; other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from candlewick.llm.common import stored, table

LEAF_BYTES = 1 << 16
FANOUT = 16
SPREAD = 1024  # records without an offset in a leaf


def record_hashes(records: DataFrame, leaf_bytes: int = LEAF_BYTES, spread: int = 1) -> DataFrame:
    """file, leaf, offset, record_id, length, digest of every record; those
    without an offset are in the leaves -1 to -``spread``."""
    at = F.coalesce("offset", F.lit(-1)).cast("long")
    digest = F.sha2(F.concat_ws("|", at, F.coalesce(F.col("record_id").cast("string"), F.lit("-")),
                                F.coalesce(F.sha2("payload", 256), F.lit("null"))), 256)
    return records.select("file", F.when(at >= 0, F.floor(at / leaf_bytes)).otherwise(-1 - F.pmod(F.xxhash64("record_id"), F.lit(spread))).alias("leaf"), at.alias("offset"), "record_id",
                          F.coalesce(F.octet_length("payload"), F.lit(0)).cast("long").alias("length"), digest.alias("digest"))


def _node(order: str) -> F.Column:
    listed = F.sort_array(F.collect_list(F.struct(order, "digest")))
    return F.sha2(F.concat_ws(",", F.transform(listed, lambda x: x["digest"])), 256).alias("digest")


def leaves(hashed: DataFrame) -> DataFrame:
    """Equal records are one child with their number, if there are several."""
    counted = hashed.groupBy("file", F.col("leaf").alias("node"), "offset", "digest").agg(F.count(F.lit(1)).alias("_n"))
    named = counted.withColumn("digest", F.when(F.col("_n") > 1, F.concat_ws("*", "digest", "_n")).otherwise(F.col("digest")))
    return named.groupBy("file", "node").agg(_node("offset"))


def parents(nodes: DataFrame, fanout: int = FANOUT) -> DataFrame:
    return (nodes.withColumn("_up", F.floor(F.col("node") / fanout)).groupBy("file", F.col("_up"))
            .agg(_node("node")).select("file", F.col("_up").alias("node"), "digest"))


def _same(left: DataFrame, right: DataFrame, names: list[str]) -> F.Column:
    out = None
    for n in names:
        one = left[n].eqNullSafe(right[n])
        out = one if out is None else out & one
    return out


def _mismatches(a: DataFrame, b: DataFrame) -> DataFrame:
    """file, node where the digests differ or one side has none."""
    a, b = a.alias("a"), b.alias("b")
    met = a.join(b, F.col("a.file").eqNullSafe(F.col("b.file")) & (F.col("a.node") == F.col("b.node")), "full_outer")
    return met.where(~F.col("a.digest").eqNullSafe(F.col("b.digest"))).select(
        F.when(F.col("a.node").isNotNull(), F.col("a.file")).otherwise(F.col("b.file")).alias("file"),
        F.coalesce("a.node", "b.node").alias("node"))


def _below(nodes: DataFrame, bad: DataFrame, fanout: int) -> DataFrame:
    """Nodes whose parent mismatches."""
    bad = bad.select(F.col("file").alias("_file"), F.col("node").alias("_node"))
    return nodes.join(bad, nodes["file"].eqNullSafe(bad["_file"]) & (F.floor(nodes["node"] / fanout) == bad["_node"]), "left_semi")


def audit(a: DataFrame, b: DataFrame, leaf_bytes: int = LEAF_BYTES, fanout: int = FANOUT) -> DataFrame:
    """The records in which replica ``b`` differs from ``a``."""
    spread = max(-(-x.where(F.coalesce("offset", F.lit(-1)) < 0).count() // SPREAD) for x in (a, b)) or 1
    hashed = [stored(record_hashes(x, leaf_bytes, spread)) for x in (a, b)]
    top = max([spread, *(r or 0 for x in hashed for r in x.agg(F.max("leaf")).collect()[0])])
    trees = [[leaves(x)] for x in hashed]
    height = 0
    while fanout ** height <= max(top, 1) + 1:  # node -1 (no offset) ends beside node 0, under one more level
        height += 1
        for tree in trees:
            tree.append(parents(tree[-1], fanout))
    trees = [[stored(level) for level in tree] for tree in trees]
    bad = _mismatches(trees[0][height], trees[1][height])
    for level in range(height - 1, -1, -1):
        bad = _mismatches(*(_below(tree[level], bad, fanout) for tree in trees))
    bad = bad.select(F.col("file").alias("_file"), F.col("node").alias("_node"))
    found = []
    for x in hashed:
        mine = x.join(bad, x["file"].eqNullSafe(bad["_file"]) & (x["leaf"] == bad["_node"]), "left_semi")
        same = Window.partitionBy("file", "leaf", "offset", "record_id").orderBy("digest")
        found.append(mine.withColumn("nth", F.row_number().over(same)))
    x, y = found[0].alias("x"), found[1].alias("y")
    met = x.join(y, F.col("x.file").eqNullSafe(F.col("y.file")) & (F.col("x.leaf") == F.col("y.leaf")) & (F.col("x.offset") == F.col("y.offset"))
                 & F.col("x.record_id").eqNullSafe(F.col("y.record_id")) & (F.col("x.nth") == F.col("y.nth")), "full_outer")
    left = F.col("x.nth").isNotNull()

    def either(name: str) -> F.Column:
        return F.when(left, F.col(f"x.{name}")).otherwise(F.col(f"y.{name}")).alias(name)

    status = F.when(F.col("y.nth").isNull(), "missing").when(~left, "extra").otherwise("changed")
    return met.where(~F.col("x.digest").eqNullSafe(F.col("y.digest"))).select(
        either("file"), either("offset"), either("record_id"), F.col("x.length").alias("length_a"), F.col("y.length").alias("length_b"),
        status.alias("status"),
        F.greatest(either("leaf"), F.lit(-1)).alias("leaf"))


# -- stand-in input: the driver's pages as WARC records of two replicas --------
PAGES_A_FILE = 500


def page_records(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Replica a holds every page; in replica b some records are damaged, cut
    short, lost, or there a second time under another id.  Some have no offset
    in either.  Rows are in the schema of ``audit``."""
    pages = table(spark, sf_dir, "pages")
    files = max(1, -(-pages.count() // PAGES_A_FILE))
    body = F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce("url", F.lit("")),
                    F.lit("\r\n\r\n"), F.coalesce("html", F.lit("")), F.lit("\r\n\r\n"))
    rows = pages.select((F.col("page_id") % files).alias("file"), F.col("page_id").alias("record_id"), body.alias("payload"))
    before = Window.partitionBy("file").orderBy("record_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("offset", F.coalesce(F.sum(F.octet_length("payload")).over(before), F.lit(0)).cast("long"))
    damaged = (F.when(F.col("record_id") % 101 == 7, F.concat(F.expr("left(payload, length(payload) - 1)"), F.lit("X")))
               .when(F.col("record_id") % 211 == 11, F.expr("left(payload, length(payload) div 2)")).otherwise(F.col("payload")))
    rows = rows.withColumn("offset", F.when(F.col("record_id") % 53 != 3, F.col("offset")))
    more = rows.where("record_id % 89 = 5").withColumn("record_id", -F.col("record_id"))
    other = rows.where("record_id % 307 <> 13").withColumn("payload", damaged).unionByName(more)
    return tuple(x.select("file", "offset", "record_id", F.encode("payload", "utf-8").alias("payload")) for x in (rows, other))


ORACLE = f"""
WITH n AS (SELECT greatest(1, CAST(ceil(count(*) / {PAGES_A_FILE}.0) AS BIGINT)) AS files FROM pages),
body AS (
  SELECT page_id % files AS file, page_id AS record_id,
         'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '')
         || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS payload
  FROM pages, n),
placed AS (SELECT *, CAST(coalesce(sum(strlen(payload)) OVER (PARTITION BY file ORDER BY record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_byte FROM body),
a AS (SELECT file, record_id, payload, CASE WHEN record_id % 53 <> 3 THEN start_byte ELSE -1 END AS "offset" FROM placed),
b AS (
  SELECT file, record_id, "offset",
         CASE WHEN record_id % 101 = 7 THEN left(payload, length(payload) - 1) || 'X'
              WHEN record_id % 211 = 11 THEN left(payload, length(payload) // 2) ELSE payload END AS payload
  FROM a WHERE record_id % 307 <> 13
  UNION ALL SELECT file, -record_id, "offset", payload FROM a WHERE record_id % 89 = 5)
SELECT file, "offset", record_id, CAST(strlen(a.payload) AS BIGINT) AS length_a, CAST(strlen(b.payload) AS BIGINT) AS length_b,
       CASE WHEN b.payload IS NULL THEN 'missing' WHEN a.payload IS NULL THEN 'extra' ELSE 'changed' END AS status,
       CASE WHEN "offset" < 0 THEN -1 ELSE "offset" // {LEAF_BYTES} END AS leaf
FROM a FULL JOIN b USING (file, record_id, "offset")
WHERE a.payload IS DISTINCT FROM b.payload
"""
