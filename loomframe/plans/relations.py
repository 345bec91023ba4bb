"""Domain relations as projections of the star-schema tables.

Each is one SQL text that Spark and DuckDB both run; what differs between the
dialects stands in DIALECTS. Spark reads the Parquet files in place, so filters and
column choices reach the scan.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

DIALECTS = {
    "spark": {
        "us": lambda c: f"unix_micros(cast({c} as timestamp))",
        "k": lambda c: f"cast(get_json_object({c}, '$.k') as bigint)",
        "pixels": lambda c: f"posexplode({c}) as (p, e)",
        "samples": lambda c: f"transform({c}, e -> cast(least(255, greatest(0, floor((cast(e as double) + 1) * 127.5))) as bigint))",
    },
    "duckdb": {
        "us": lambda c: f"epoch_us({c})",
        "k": lambda c: f"cast(json_extract_string({c}, '$.k') as bigint)",
        "pixels": lambda c: f"unnest(range(64)) as p, unnest({c}) as e",
        "samples": lambda c: f"list_transform({c}, lambda e: cast(least(255, greatest(0, floor((cast(e as double) + 1) * 127.5))) as bigint))",
    },
}

#: 2024-01-01 in microseconds: packets count from there.
EPOCH = 1_704_067_200_000_000

RELATIONS = {
    "licenses": """select c_custkey as license_id, c_name as owner, c_custkey * 10 as created,
        case c_custkey % 3 when 0 then 'active' when 1 then 'archived' else 'deleted' end as record_state from {customer}""",
    "license_keys": """select o_orderkey as key_id, o_custkey as license_id, concat('KEY-', cast(o_orderkey as string)) as key_value,
        o_orderstatus <> 'P' as active, {us:o_orderdate} div 1000000 as created,
        case o_orderstatus when 'F' then 'active' when 'O' then 'archived' else 'deleted' end as record_state from {orders}""",
    "license_features": """select distinct l_orderkey % 1500 as license_id, case l_linenumber when 1 then 'basic' when 2 then 'editor' when 3 then 'import'
        when 4 then 'export' when 5 then 'legacy-x' else 'batch' end as feature_name from {lineitem} where l_orderkey % 5 <> 0""",
    "installations": """select concat(cast(user_id as string), '-', cast(event_id % 4 as string)) as installation_id, user_id as license_id, event_id % 4 as device,
        min({us:ts} div 1000000) as first_seen, max({us:ts} div 1000000) as last_seen, max(case when event_type = 'signup' then 1 else 0 end) as trusted,
        case max(event_id % 7) when 0 then 'deleted' when 1 then 'archived' else 'active' end as record_state from {events} group by user_id, event_id % 4""",
    "verification_requests": """select event_id as request_id, user_id as license_id, event_id % 4 as device, {us:ts} div 1000000 as created,
        {us:ts} div 1000000 + 72 * 3600 as expires, case when {k:props} % 2 = 0 then {us:ts} div 1000000 + 60 end as approved,
        case when event_id % 11 = 0 then 'deleted' else 'active' end as record_state from {events} where event_type = 'signup'""",
    "audit_events": """select event_id, user_id as license_id, event_type, props as payload, {us:ts} div 1000000 as created,
        case event_id % 5 when 0 then 'archived' when 1 then 'deleted' else 'active' end as record_state from {events}""",
    "email_outbox": """select conv_id * 1000 + turn as email_id, conv_id as license_id, role, turn * 60 as created,
        case turn % 4 when 0 then 'queued' when 1 then 'sent' when 2 then 'delivered' else 'read' end as state from {conversations}""",
    "playback_requests": """select event_id as request_id, case when event_id % 3 = 0 then null else user_id end as license_id, event_type as codec, {us:ts} div 1000000 as created,
        case event_id % 6 when 0 then 'archived' when 1 then 'deleted' else 'active' end as record_state from {events} where event_type in ('view', 'error')""",
    "tracks": """select * from (values (cast(1 as bigint), 'video', 'native_video', cast(90000 as bigint)), (2, 'audio', 'native_audio', 48000), (3, 'data', 'subtitle', 1000)) as t(track_id, kind, codec, timescale)""",
    "packets": """select user_id % 3 + 1 as track_id, event_id as sequence, {us:ts} - 1704067200000000 as us,
        ({us:ts} - 1704067200000000) * case user_id % 3 when 0 then 90000 when 1 then 48000 else 1000 end div 1000000 as pts,
        case event_type when 'signup' then 1 when 'error' then 16 when 'purchase' then 2 else 0 end as flags,
        cast(floor(value * 10) as bigint) + 32 as size from {events}""",
    "sweep_rows": """select l_orderkey as clip, l_linenumber as line, l_partkey as part, cast(18 + 4 * (l_linenumber % 4) as bigint) as qp,
        case when l_returnflag = 'A' then 'compact' else 'entropy' end as inter_syntax, case when l_returnflag = 'R' then 'context' else 'static' end as entropy_model,
        case when l_linestatus = 'F' then 'header-aware' else 'rdo-fast' end as cost_model, case when l_suppkey % 2 = 0 then 'fixed16x16' else 'auto-fast' end as inter_partition,
        cast(floor(l_extendedprice) as bigint) as bytes, 1 - l_discount as ssim, l_quantity as psnr, l_tax > 0.01 as ok from {lineitem}""",
    "blocks": """select block, cast(p as bigint) as p, cast(p as bigint) div 8 as y, cast(p as bigint) % 8 as x, cast(least(255, greatest(0, floor((cast(e as double) + 1) * 127.5))) as bigint) as v
        from (select vec_id as block, {pixels:embedding} from {embeddings})""",
    "tiles": """select vec_id as block, {samples:embedding} as v from {embeddings} where embedding is not null""",
    "audio": """select block as stream, p, cast(trunc_e as bigint) as s from (select block, p, floor(cast(e as double) * 32767) as trunc_e from (select vec_id as block, {pixels:embedding} from {embeddings}))""",
}


def text(name: str, dialect: str, place) -> str:
    """The SQL of a relation: {table} by place(), and {macro:argument} by the dialect."""
    macros = DIALECTS[dialect]
    sql = re.sub(r"\{(\w+)(?::([^}]*))?\}", lambda m: macros[m[1]](m[2]) if m[2] else place(m[1]), RELATIONS[name])
    return sql if dialect == "spark" else re.sub(r"\bdiv\b", "//", sql.replace(" as string)", " as varchar)"))


#: DuckDB's own words for some relations, so that their queries share no text with Spark's.
BY_HAND = {
    "packets": """select 1 + user_id % 3 as track_id, event_id as sequence, epoch_us(ts) - epoch_us(timestamp '2024-01-01') as us,
        (epoch_us(ts) - epoch_us(timestamp '2024-01-01')) * [90000, 48000, 1000][1 + user_id % 3] // 1000000 as pts,
        map {'signup': 1, 'error': 16, 'purchase': 2, 'view': 0, 'click': 0}[event_type] as flags, 32 + cast(floor(10 * value) as bigint) as size from events""",
    "sweep_rows": """select l_orderkey as clip, l_linenumber as line, l_partkey as part, cast([18, 22, 26, 30][1 + l_linenumber % 4] as bigint) as qp,
        if(l_returnflag = 'A', 'compact', 'entropy') as inter_syntax, if(l_returnflag = 'R', 'context', 'static') as entropy_model, if(l_linestatus = 'F', 'header-aware', 'rdo-fast') as cost_model,
        ['fixed16x16', 'auto-fast'][1 + l_suppkey % 2] as inter_partition, cast(floor(l_extendedprice) as bigint) as bytes, 1 - l_discount as ssim, l_quantity as psnr, l_tax > 0.01 as ok from lineitem""",
    "blocks": """select block, cast(i - 1 as bigint) as p, cast((i - 1) // 8 as bigint) as y, cast((i - 1) % 8 as bigint) as x, cast(greatest(0, least(255, floor(127.5 * (1 + cast(embedding[i] as double))))) as bigint) as v
        from (select vec_id as block, embedding, unnest(range(1, len(embedding) + 1)) as i from embeddings)""",
    "license_keys": """select o_orderkey as key_id, o_custkey as license_id, 'KEY-' || o_orderkey as key_value, o_orderstatus in ('F', 'O') as active, epoch_us(o_orderdate) // 1000000 as created,
        map {'F': 'active', 'O': 'archived', 'P': 'deleted'}[o_orderstatus] as record_state from orders""",
}


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.sql(text(name, "spark", lambda t: f"parquet.`{sf_dir}/{t}.parquet`"))


def oracle(sql: str) -> str:
    """A DuckDB query with the relations that it names as common table expressions."""
    used = [n for n in RELATIONS if re.search(rf"\b{n}\b", sql)]
    head = ", ".join(f"{n} as ({BY_HAND.get(n) or text(n, 'duckdb', str)})" for n in used)
    body = sql.strip()
    if not head:
        return body
    return f"with recursive {head}, {body[5:]}" if body[:5].lower() == "with " else f"with {head} {body}"
