"""The driver's tables as the engine's tables: the same SQL for Spark and DuckDB, but for the time functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_SECONDS = {"spark": "timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', ts)", "duck": "epoch_us(ts) // 1000000"}
_ORDERED = {"spark": "unix_date(cast(o_orderdate as date))", "duck": "(cast(o_orderdate as date) - date '1970-01-01')"}


def _sql(dialect: str) -> dict[str, str]:
    t, day = _SECONDS[dialect], _ORDERED[dialect]
    return {
        "frames": f"""select event_id as photo_id, concat('d', cast(user_id % 4 as string)) as dir,
  case when user_id % 7 = 0 then null else concat('cam', cast(user_id % 5 as string)) end as camera,
  case when event_id % 53 = 0 then null else {t} end as captured_at,
  round(value, 1) as m0, (event_id * 37) % 101 / 1e0 as m1, 1e0 + (event_id * 13) % 50 / 1e1 as m2, (event_id * 7) % 100 / 1e2 as m3,
  (event_id * 11) % 97 / 97e0 as m4, (event_id * 5) % 20 / 1e3 as m5, (event_id * 3) % 17 / 1e3 as m6, (event_id * 19) % 41 / 1e1 as m7 from events""",
        "shots": f"""select event_id as photo_id, concat('cam', cast(user_id % 3 as string)) as camera, case when event_id % 41 = 0 then null else {t} end as captured_at,
  case when event_id % 29 = 0 then null else event_id % 5 end as hash, 1e0 / (30 + 30 * (event_id % 4)) as exposure_time, cast(case when event_id % 3 = 0 then 200 else 100 end as int) as iso from events""",
        "photo": """select o_orderkey as id, concat('root/', lower(o_orderpriority), '/c', cast(o_custkey % 12 as string)) as dir, concat('img_', cast(o_orderkey as string)) as stem,
  case when o_orderstatus = 'F' then 'pair' when o_orderstatus = 'O' then 'raw_only' else 'raster_only' end as state,
  case when o_orderkey % 17 = 0 then cast(1 as bigint) end as trashed_at from orders""",
        "file": """select l_orderkey * 8 + l_linenumber as id, l_orderkey as photo_id,
  concat('root/', cast(l_orderkey as string), '.', case l_linenumber % 4 when 0 then 'jpg' when 1 then 'cr3' when 2 then 'xmp' else 'mp4' end) as path,
  case l_linenumber % 4 when 0 then 'raster' when 1 then 'raw' when 2 then 'sidecar' else 'video' end as role,
  cast(l_quantity * 1000 as bigint) as size_bytes, l_partkey * 1000000 as mtime_ns from lineitem""",
        "score": "select o_orderkey as photo_id, o_totalprice / 5e3 as composite from orders where o_orderkey % 5 != 0",
        "decision": "select o_orderkey as photo_id, cast(o_custkey % 6 as int) as rating, o_custkey % 11 = 0 as rejected from orders where o_orderkey % 3 = 0",
        "metadata": f"select o_orderkey as photo_id, c_mktsegment as camera, concat('lens ', cast(c_nationkey % 5 as string)) as lens, {day} as captured_at, cast(extract(year from o_orderdate) as int) as year from orders join customer on o_custkey = c_custkey where o_orderkey % 9 != 0",
        "quality": "select o_orderkey as photo_id, (o_orderkey * 7) % 101 / 1e0 as focus, (o_orderkey * 13) % 101 / 1e0 as noise, (o_orderkey * 29) % 101 / 1e0 as detail from orders where o_orderkey % 4 != 0",
        "tag": "select event_id as photo_id, concat(' ', upper(event_type), ' ') as name, (event_id * 31) % 100 / 1e2 as confidence, concat('m', cast(user_id % 2 as string)) as model from events union all select event_id % 50, event_type, value / 1e3, 'm0' from events",
        "face": "select vec_id as id, vec_id % 200 as file_id, label as person_id, embedding as vector from embeddings",
        "exif": "select l_orderkey * 8 + l_linenumber as file_id, min(concat('make', cast(l_suppkey % 3 as string))) as make, min(cast(l_partkey % 7 as string)) as model from lineitem where l_linenumber % 2 = 1 group by l_orderkey * 8 + l_linenumber",
    }


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables, read from the driver's Parquet files."""
    text = _sql("spark")[name]
    for table in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings"):
        text = text.replace(f"from {table}", f"from parquet.`{sf_dir}/{table}.parquet`").replace(f"join {table}", f"join parquet.`{sf_dir}/{table}.parquet`")
    return spark.sql(text)


def ctes(*names: str) -> str:
    """``with`` clauses of the tables for DuckDB; a name is prefixed with t_."""
    return ", ".join(f"t_{n} as ({_sql('duck')[n]})" for n in names)
