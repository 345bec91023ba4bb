"""Changes to the licensing tables as the rows that they leave or add, with their audit rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomframe.operators.relational import FEATURES, state_rank

#: Fixed names of states and features for people.
STATE_NAMES = {"active": "Active", "archived": "Archived", "deleted": "Deleted"}
FEATURE_NAMES = {"basic": "Basic playback", "editor": "Editor workspace", "import": "Import", "export": "Export", "batch": "Batch processing"}


def named(column: str, names: dict[str, str], otherwise: str | None = None) -> Column:
    """The display name of a slug; an unknown slug gets the other name, or none."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), F.col(column)), F.lit(otherwise))


def slugs(features: DataFrame) -> DataFrame:
    """How often each feature slug is granted, its display name, and whether it is known; unknown ones count as basic."""
    counts = features.groupBy("feature_name").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("feature_name", named("feature_name", FEATURE_NAMES, FEATURE_NAMES["basic"]).alias("display"), F.col("feature_name").isin(*FEATURES).alias("known"), "n")


def states(keys: DataFrame) -> DataFrame:
    """Keys with the switch as a boolean and the state as a known one: unknown and missing states are active."""
    known = F.when(F.col("raw_state").isin(*STATE_NAMES), F.col("raw_state")).otherwise("active")
    return keys.select("key_id", (F.col("raw_active") == 1).alias("active"), known.alias("record_state"), named("raw_state", STATE_NAMES, STATE_NAMES["active"]).alias("display"))


def ordered_keys(keys: DataFrame) -> DataFrame:
    """The full list of keys, newest first within a state: dealt by range, sorted within, no window over all rows."""
    return keys.orderBy(state_rank(), F.desc("created"), "key_id").select("key_id", "license_id", "created", "record_state")


def allowed(licenses: DataFrame, features: DataFrame, feature: str) -> DataFrame:
    """Whether each licence allows a feature: it must be active and hold it; a licence without known features holds basic."""
    held = features.where(F.col("feature_name").isin(*FEATURES)).groupBy("license_id").agg(F.collect_set("feature_name").alias("held"))
    own = licenses.join(held, "license_id", "left").withColumn("held", F.coalesce("held", F.array(F.lit("basic"))))
    return own.select("license_id", ((F.col("record_state") == "active") & F.array_contains("held", feature)).alias("allowed"))


def unknown_licenses(requests: DataFrame, licenses: DataFrame) -> DataFrame:
    """Requests whose licence doesn't exist: existence by a semi join on ids, not by a count for each."""
    return requests.where("license_id is not null").join(licenses.select("license_id"), "license_id", "left_anti").select("request_id", "license_id")


def changes(*rows: DataFrame) -> DataFrame:
    """Rows of several tables in one: table_name, id, license_id, field and value."""
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def change(df: DataFrame, table: str, key: Column, field: str, value: Column) -> DataFrame:
    return df.select(F.lit(table).alias("table_name"), key.cast("string").alias("id"), "license_id", F.lit(field).alias("field"), value.cast("string").alias("value"))


def issue(requests: DataFrame, now: int) -> DataFrame:
    """What issuing a licence for each request adds: licence, key, features (basic if none are asked for) and audit row, as changes. One append of the frame is one commit."""
    r = requests.select("license_id", "owner", "asked")
    wanted = F.when(F.size("asked") > 0, F.col("asked")).otherwise(F.array(F.lit("basic")))
    key = F.concat(F.lit("key-"), F.col("license_id").cast("string"))
    payload = F.to_json(F.struct(F.col("owner").alias("email"), F.array_sort(wanted).alias("features")))
    return changes(
        change(r, "licenses", F.col("license_id"), "created", F.lit(now)),
        change(r, "license_keys", key, "active", F.lit(True)),
        change(r.withColumn("f", F.explode(wanted)), "license_features", F.col("license_id"), "feature_name", F.col("f")),
        change(r, "audit_events", key, "license_issued", payload),
    )


def cascade(tables: dict[str, tuple[DataFrame, str]], chosen: Column, state: str) -> DataFrame:
    """The rows that a change of state of some licences changes in every table that hangs on them; rows in that state already are left alone."""
    return changes(*[change(df.where(chosen & (F.col("record_state") != state)), t, F.col(key), "record_state", F.lit(state)) for t, (df, key) in tables.items()])


def set_state(keys: DataFrame, chosen: Column, state: str) -> DataFrame:
    """A change of state of single keys: the changed row and an audit row for each."""
    own = keys.where(chosen)
    return changes(change(own, "license_keys", F.col("key_id"), "record_state", F.lit(state)), change(own, "audit_events", F.col("key_id"), "admin_key_state_updated", F.to_json(F.struct(F.lit(state).alias("state")))))


def approve(requests: DataFrame, chosen: Column, now: int) -> DataFrame:
    """Approval of requests: those not approved yet get the time and an audit row, others stay as they are."""
    own = requests.where(chosen & F.col("approved").isNull())
    return changes(change(own, "verification_requests", F.col("request_id"), "approved", F.lit(now)), change(own, "audit_events", F.col("request_id"), "admin_request_approved", F.to_json(F.struct(F.col("request_id")))))


def migrate(table: DataFrame, wanted: dict[str, tuple[str, object]]) -> DataFrame:
    """A table with columns added that it lacks, with their defaults; those it has stay."""
    return table.withColumns({c: F.lit(default).cast(kind) for c, (kind, default) in wanted.items() if c not in table.columns})
