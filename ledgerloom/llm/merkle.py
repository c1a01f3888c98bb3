"""Merkle manifest of a table: a tree of sha256 digests over its rows, with a proof for each row.

A row's leaf is a digest of some of its columns. The leaves of a group (of a
source), by id, are joined 16 at a time, level by level, until one node, the
subroot, remains; the subroots, by group, are joined likewise to the root.

Spark numbers the rows of each group by a sort and counts per partition, so no
task takes a group. Blocks of 4096 numbers are whole subtrees of three levels,
so each is worked out alone: executors gather blocks that are aligned so, some
16,000 rows at a time, as Arrow tables and run DuckDB level queries on them
(ordered string_agg, then sha256). Spark joins the blocks' roots to the root, with
runs of 16 rows, and walks down again for each block's outer proof. A second
pass over the blocks adds it to the proofs inside.
"""

from __future__ import annotations

from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import free_names, written

FAN = 16
#: Levels inside a block, and the leaves that one holds.
LEVELS = 3
BLOCK = FAN**LEVELS
#: Rows that a DuckDB query takes at once, and one more block at most.
GATHERED = 4 * BLOCK

PATH = T.ArrayType(T.StructType([T.StructField("left", T.StringType()), T.StructField("right", T.StringType())]))
_PATH = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def _no_path() -> Column:
    return F.array().cast(PATH)


def leaf(*columns: Column) -> Column:
    """The digest of a row: of each column its bytes' count, a colon and its value, or `-` if it is null."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def folded(own: Column, proof: Column) -> Column:
    """The root that a leaf and a proof give."""
    return F.aggregate(proof, own, lambda node, run: F.sha2(F.concat(run["left"], node, run["right"]), 256))


def proof_digest(proof: Column) -> Column:
    """The digest of all siblings, level by level, left to right."""
    return F.sha2(F.concat_ws("", F.transform(proof, lambda run: F.concat(run["left"], run["right"]))), 256)


def _numbered(rows: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """The rows with `i`, their place in their group from 0, and `n`, the group's rows.

    After a sort of the whole table each partition has a part of a group or whole
    groups in order, so a row's place is its place there and the counts before.
    """
    placed = F.monotonically_increasing_id()  # the partition in the upper bits, the place in the lower 33
    ordered = written(rows.orderBy(group, *order).withColumn("i", placed)).withColumn("part", F.shiftright("i", 33))
    counts = ordered.groupBy(group, "part").agg(F.count("*").alias("here"), F.min("i").alias("first"))
    parts = Window.partitionBy(group)
    before = F.sum("here").over(parts.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(group, "part", F.sum("here").over(parts).alias("n"), (F.col("first") - F.coalesce(before, F.lit(0))).alias("first"))
    return ordered.join(counts, [group, "part"]).withColumn("i", F.col("i") - F.col("first")).drop("part", "first")


def _joined(nodes: DataFrame, group: str) -> tuple[DataFrame, DataFrame]:
    """(group, hash) of each group's root, and (group, i, path) from each node up to it; nodes: group, i, n, hash."""
    levels, roots, now = [], nodes.where("n = 1").select(group, "hash"), nodes.where("n > 1")
    while not now.isEmpty():
        run = F.array_sort(F.collect_list(F.struct("i", "hash")))
        up = now.groupBy(group, F.floor(F.col("i") / FAN).alias("i")).agg(run.alias("run"), F.ceil(F.first("n") / FAN).alias("n"))
        up = written(up.withColumn("joined", F.concat_ws("", "run.hash")).withColumn("hash", F.sha2("joined", 256)))
        levels.append(up)
        roots = roots.unionByName(up.where("n = 1").select(group, "hash"))
        now = up.where("n > 1").select(group, "i", "n", "hash")
    above = None
    for up in reversed(levels):
        top = up.where("n = 1").withColumn("path", _no_path())
        if above is not None:
            top = top.unionByName(up.where("n > 1").join(above, [group, "i"]))
        left, right = F.expr("substring(joined, 1, 64 * pos)"), F.expr("substring(joined, 64 * pos + 65)")
        each = top.select(group, "joined", "path", F.posexplode("run").alias("pos", "node"))
        above = each.select(group, F.col("node.i").alias("i"), F.concat(F.array(F.struct(left.alias("left"), right.alias("right"))), "path").alias("path"))
        if up is not levels[0]:
            above = written(above)
    alone = nodes.where("n = 1").select(group, "i", _no_path().alias("path"))
    return roots, alone if above is None else above.unionByName(alone)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole blocks from rows that are sorted by block."""
    held: list[pa.Table] = []
    for batch in batches:
        held.append(pa.Table.from_batches([batch]))
        while sum(t.num_rows for t in held) > GATHERED + BLOCK:
            table = pa.concat_tables(held)
            starts = _starts(table)
            stop = int(starts[np.searchsorted(starts, GATHERED, "right") - 1])
            yield table.slice(0, stop)
            held = [table.slice(stop)]
    if held:
        yield pa.concat_tables(held)


def _starts(table: pa.Table) -> np.ndarray:
    """The rows at which a block begins."""
    key, block = table.column("key").combine_chunks().dictionary_encode().indices.to_numpy(), table.column("block").to_numpy()
    return np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (block[1:] != block[:-1])))


def _levels(con: duckdb.DuckDBPyConnection, table: pa.Table) -> np.ndarray:
    """Makes the tables run0, run1, ... (g, p, joined): of block g, the digests of each run of 16; returns where blocks begin."""
    starts = _starts(table)
    g = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, table.num_rows)))
    nodes = pa.table({"g": g, "i": table.column("i"), "n": table.column("n"), "h": table.column("leaf")})
    con.register("nodes", nodes)
    # outer rows are no leaves; a group of one leaf has no level, one of up to 16 has one, and so on
    con.execute(f"CREATE OR REPLACE TEMP TABLE level0 AS SELECT g, i % {BLOCK} AS i, h, least(n, {BLOCK}) AS n FROM nodes WHERE i >= 0")
    for k in range(LEVELS):
        con.execute(f"CREATE OR REPLACE TEMP TABLE run{k} AS SELECT g, i // {FAN} AS p, n, string_agg(h, '' ORDER BY i) AS joined FROM level{k} WHERE n > {FAN**k} GROUP BY ALL")
        con.execute(f"CREATE OR REPLACE TEMP TABLE level{k + 1} AS SELECT g, p AS i, n, sha256(joined) AS h FROM run{k}")
    return starts


def _connection() -> duckdb.DuckDBPyConnection:
    return duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "512MB"})


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, i, n, hash): of each block its root, its number and the blocks of its group."""
    with _connection() as con:
        for table in _gathered(batches):
            starts = _levels(con, table)
            top = " UNION ALL ".join(f"SELECT g, h FROM level{k} WHERE n <= {FAN**k}" + (f" AND n > {FAN ** (k - 1)}" if k else "") for k in range(LEVELS + 1))
            found = con.execute(f"SELECT h FROM ({top}) ORDER BY g").fetchnumpy()["h"]
            first = table.take(starts)
            n = (first.column("n").to_numpy() + BLOCK - 1) // BLOCK
            yield pa.RecordBatch.from_arrays([first.column("key").combine_chunks(), first.column("block").combine_chunks(), pa.array(n), pa.array(found, pa.string())], names=["key", "i", "n", "hash"])


def _proofs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The leaves' rows, with the proof inside the block and then that of the block, whose row comes before them."""
    with _connection() as con:
        for table in _gathered(batches):
            starts = _levels(con, table)
            rows = table.filter(pc.greater_equal(table.column("i"), 0))
            outer = table.take(starts)  # i = -1
            con.register("outer_rows", pa.table({"g": np.arange(len(starts)), "path": outer.column("path"), "subroot": outer.column("subroot"), "root": outer.column("root")}))
            side = ", ".join(f"CASE WHEN r{k}.joined IS NULL THEN NULL ELSE {{'left': substr(r{k}.joined, 1, 64 * (i // {FAN**k} % {FAN})), 'right': substr(r{k}.joined, 64 * (i // {FAN**k} % {FAN}) + 65)}} END" for k in range(LEVELS))
            runs = " ".join(f"LEFT JOIN run{k} r{k} ON r{k}.g = x.g AND r{k}.p = x.i // {FAN ** (k + 1)}" for k in range(LEVELS))
            found = con.sql(f"SELECT list_concat(list_filter([{side}], lambda s: s IS NOT NULL), path) AS proof, subroot, root FROM level0 x {runs} JOIN outer_rows o ON o.g = x.g ORDER BY x.g, x.i").to_arrow_table()
            made = {"proof": found.column("proof").cast(_PATH), "subroot": found.column("subroot"), "root": found.column("root")}
            out = rows.drop_columns(["key", "block", "i", "n", "path", "subroot", "root"])
            for name, column in made.items():
                out = out.append_column(name, column)
            yield from out.combine_chunks().to_batches()


def manifest(docs: DataFrame, columns: tuple[str, ...], id_col: str = "doc_id", group: str = "source", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: the id, the columns to carry, leaf, subroot, root, proof.

    `proof` is an array of (left, right), from the leaf's run up to the subroots'
    run: the digests before and after the node in its run, as one text each. A
    node alone in its run has two empty texts; a table of one row has an empty
    proof. Null ids come first; rows of one id are ordered by leaf, and of rows
    alike in both each has a place of its own. Null values have a mark of their
    own in the leaf, so null and empty texts differ; long texts are hashed where
    they are read and go no further. Null groups are one group, before all
    others. An empty table gives no rows. Columns that aren't named are ignored.
    The columns to carry may have any names but those made here.
    """
    names = free_names(docs, *(f"c{k}" for k in range(len(carry))))  # of their own, so that no column clashes with the inner ones
    key = F.coalesce(F.concat(F.lit(":"), F.col(group).cast("string")), F.lit(""))
    slim = docs.select(
        key.alias("key"), F.col(id_col).alias("id"), leaf(*(F.col(c) for c in columns)).alias("leaf"),
        *(F.col(c).alias(n) for c, n in zip(carry, names, strict=True)), F.monotonically_increasing_id().alias("tie"),
    )
    order = [F.col("id").asc_nulls_first(), F.col("leaf"), F.col("tie")]
    rows = written(_numbered(written(slim), "key", order).withColumn("block", F.expr(f"i div {BLOCK}")).drop("tie"))
    aligned = ("key", "block")
    inner = rows.select("key", "block", "i", "n", "leaf").repartition(*aligned).sortWithinPartitions(*aligned, "i")
    blocks = written(inner.mapInArrow(_roots, "key string, i long, n long, hash string"))
    subroots, inside = _joined(blocks, "key")
    top = written(_numbered(subroots.withColumn("all", F.lit(0)), "all", [F.col("key")]))
    roots, across = _joined(top, "all")
    root = roots.first()  # one row, or none of an empty table
    across = top.join(across, ["all", "i"]).select("key", F.col("hash").alias("subroot"), F.col("path").alias("over"))
    outer = inside.join(across, "key").select(
        "key", F.col("i").alias("block"), F.lit(-1).cast("long").alias("i"), F.concat("path", "over").alias("path"),
        "subroot", F.lit(root["hash"] if root else None).cast("string").alias("root"),
    )
    both = rows.unionByName(outer, allowMissingColumns=True).repartition(*aligned).sortWithinPartitions(*aligned, "i")
    kept = [("id", id_col), *zip(names, carry, strict=True)]
    schema = T.StructType([*(T.StructField(a, both.schema[a].dataType) for a in both.columns if a in {"id", "leaf", *names}), T.StructField("proof", PATH), T.StructField("subroot", T.StringType()), T.StructField("root", T.StringType())])
    found = both.mapInArrow(_proofs, schema)
    return found.select(*(F.col(a).alias(b) for a, b in kept), "leaf", "subroot", "root", "proof")


_DEPTH = 8

_LEVEL = """
{t}{up} AS MATERIALIZED (
  SELECT g, i // 16 AS i, (any_value(n) + 15) // 16 AS n, CASE WHEN any_value(n) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h
  FROM {t}{k} GROUP BY g, i // 16),
{t}s{k} AS MATERIALIZED (
  SELECT g, i, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
         coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r, n
  FROM {t}{k} WINDOW w AS (PARTITION BY g, i // 16 ORDER BY i)),
"""


def _sql() -> str:
    """The whole tree in SQL, level by level."""
    leaf_of = "sha256(" + " || ".join(f"coalesce(octet_length(encode({c}))::VARCHAR || ':' || {c}, '-')" for c in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", "{text}")) + ")"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    crc = """
bits AS (SELECT range AS b, range::UINTEGER AS c0 FROM range(256)),
crc0 AS (SELECT b, list_reduce([c0, 1, 2, 3, 4, 5, 6, 7, 8], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UINTEGER) ELSE c >> 1 END) AS v FROM bits),
crc AS (SELECT list(v ORDER BY b) AS t FROM crc0),
ids AS (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL),
odd AS (SELECT doc_id, xor(list_reduce(list_prepend(4294967295::UINTEGER, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::UINTEGER)),
          lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295::UINTEGER) AS crc FROM ids, crc),
"""
    own = f"CASE WHEN crc % 5 = 0 THEN {leaf_of.format(text=lower)} ELSE {leaf_of.format(text='text')} END"
    out = f"WITH {crc} d AS MATERIALIZED (SELECT doc_id, coalesce(':' || source, '') AS g, {leaf_of.format(text='text')} AS leaf, {own} AS own FROM documents LEFT JOIN odd USING (doc_id)),\n"
    out += "a AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM d),\nx0 AS (SELECT g, i, n, leaf AS h FROM a),"
    out += "".join(_LEVEL.format(t="x", k=k, up=k + 1) for k in range(_DEPTH))
    out += f"subs AS MATERIALIZED (SELECT g AS src, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS j FROM x{_DEPTH}),\ny0 AS (SELECT 0 AS g, j AS i, count(*) OVER () AS n, subroot AS h FROM subs),"
    out += "".join(_LEVEL.format(t="y", k=k, up=k + 1) for k in range(_DEPTH))
    out += f"f0 AS (SELECT doc_id, leaf, subroot, y{_DEPTH}.h AS root, a.g, a.i, j, '' AS proof, own AS node FROM a JOIN subs ON subs.src = a.g, y{_DEPTH})"
    step = 0
    for t, g, i in (("x", "f.g", "f.i"), ("y", "0", "f.j")):
        for k in range(_DEPTH):
            out += f",\nf{step + 1} AS (SELECT doc_id, leaf, subroot, root, f.g, f.i, j, proof || l || r AS proof, CASE WHEN s.n = 1 THEN node ELSE sha256(l || node || r) END AS node FROM f{step} f JOIN {t}s{k} s ON s.g = {g} AND s.i = {i} // {FAN**k})"
            step += 1
    return out + f"\nSELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, node AS folded_root, node = root AS verified FROM f{step}"


OP11_SQL = _sql()
