"""Spatial inputs derived from the relational tables, in Spark's SQL and DuckDB's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.durable import stored

_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
_IDX = f"ROW_NUMBER() OVER (ORDER BY {','.join(_KEY)})-1"
GEO = f"""SELECT {_IDX} AS idx,
 CAST((l_orderkey*7919+l_linenumber*104729)%34910 AS DOUBLE)/CAST(97 AS DOUBLE)-CAST(179.95 AS DOUBLE) AS lng,
 CAST((l_partkey*15485863+l_linenumber*31)%16480 AS DOUBLE)/CAST(97 AS DOUBLE)-CAST(84.95 AS DOUBLE) AS lat FROM lineitem"""
CHINA = """SELECT o_orderkey AS idx, CAST((o_orderkey*7919)%5946 AS DOUBLE)/CAST(97 AS DOUBLE)+CAST(73.7 AS DOUBLE) AS lng,
 CAST((o_custkey*104729+o_orderkey)%4811 AS DOUBLE)/CAST(97 AS DOUBLE)+CAST(3.9 AS DOUBLE) AS lat FROM orders"""
CLOUD = f"""SELECT {_IDX} AS idx, l_quantity+CAST(l_partkey%97 AS DOUBLE)/CAST(97 AS DOUBLE) AS x,
 l_discount*CAST(100 AS DOUBLE)+CAST(l_suppkey%89 AS DOUBLE)/CAST(89 AS DOUBLE) AS y, l_extendedprice/CAST(997 AS DOUBLE) AS z,
 CAST(l_partkey%256 AS INT) AS r, CAST(l_suppkey%256 AS INT) AS g, CAST(l_orderkey%256 AS INT) AS b, CAST(l_partkey%24 AS INT) AS cls FROM lineitem"""
TRACKS = """SELECT user_id AS track_id, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts,event_id) AS seq,
 CAST(116 AS DOUBLE)+CAST((event_id*7919)%997 AS DOUBLE)/CAST(997 AS DOUBLE) AS lng,
 CAST(39 AS DOUBLE)+CAST((event_id*104729)%997 AS DOUBLE)/CAST(997 AS DOUBLE) AS lat, value AS ele FROM events"""
_RING = "SELECT n_nationkey AS geom_id, k AS seq, -170+n_nationkey*13+3*cos(2*pi()*(k%12)/12) AS lng, -60+(n_nationkey*7)%120+3*sin(2*pi()*(k%12)/12) AS lat FROM nation"
RINGS = {"spark": _RING + " LATERAL VIEW explode(sequence(0,12)) e AS k", "duckdb": _RING + ", range(13) r(k)"}
GRID = {"spark": "SELECT vec_id AS row, pos AS col, CAST(v AS DOUBLE)*100 AS z FROM embeddings LATERAL VIEW posexplode(embedding) e AS pos, v",
        "duckdb": "SELECT vec_id AS row, i AS col, CAST(embedding[i+1] AS DOUBLE)*100 AS z FROM embeddings, range(64) r(i)"}
_SOURCE = {"geo": (GEO, "lineitem"), "china": (CHINA, "orders"), "cloud": (CLOUD, "lineitem"), "tracks": (TRACKS, "events"), "rings": (RINGS, "nation"), "grid": (GRID, "embeddings")}


_LINES: dict = {}


def _lines(session: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with its row number by _KEY: rows are dealt out by range, sorted and numbered
    where they lie, and each part starts where the parts before it end, so no task sees all
    rows. Kept for the session in the checkpoint folder."""
    key = (session.sparkContext.applicationId, sf_dir)
    if key not in _LINES:
        rows = session.read.parquet(f"{sf_dir}/lineitem.parquet").select(*_KEY, "l_quantity", "l_discount")
        rows = stored(rows.repartitionByRange(*_KEY).sortWithinPartitions(*_KEY).withColumn("at", F.monotonically_increasing_id()))
        part = F.shiftright("at", 33).cast("int")
        starts, n = {}, 0
        for r in rows.groupBy(part.alias("part")).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).orderBy("part").collect():  # a row a partition
            starts[r["part"]] = n - r["first"]
            n += r["n"]
        shift = F.get(F.array(*[F.lit(starts.get(i, 0)).cast("long") for i in range(max(starts, default=0) + 1)]), part)
        _LINES[key] = rows.withColumn("idx", F.col("at") + shift).drop("at")
    return _LINES[key]


def spark(session: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text, source = _SOURCE[name]
    text = text if isinstance(text, str) else text["spark"]
    rows = _lines(session, sf_dir) if source == "lineitem" else session.read.parquet(f"{sf_dir}/{source}.parquet")
    df = session.sql(text.replace(_IDX, "idx").replace(f"FROM {source}", "FROM {t}"), t=rows)
    return df.withColumns({c: df[c].cast("long") for c in ("idx", "row", "col", "seq") if c in df.columns})


def duckdb(name: str) -> str:
    text, _ = _SOURCE[name]
    return text if isinstance(text, str) else text["duckdb"]
