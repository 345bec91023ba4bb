"""The licensing tables: lookups, counts, lists, decisions and mutations from an old table to a new one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Features that are known, and the order of record states.
FEATURES = ("basic", "editor", "import", "export", "batch")
STATES = ("active", "archived", "deleted")


def state_rank(c: str = "record_state") -> Column:
    return F.when(F.col(c) == "active", 0).when(F.col(c) == "archived", 1).otherwise(2)


def snapshot(licenses: DataFrame, keys: DataFrame, installs: DataFrame, requests: DataFrame, audits: DataFrame) -> DataFrame:
    """One row of counts, each table read once. Active keys count whatever their record state."""
    one = lambda df, *aggs: df.agg(*aggs)
    parts = [
        one(licenses, F.count(F.lit(1)).alias("licenses")),
        one(keys, F.count(F.lit(1)).alias("keys"), F.count_if(F.expr("active")).alias("active_keys")),
        one(installs, F.count(F.lit(1)).alias("installations"), F.count_if(F.expr("trusted = 1")).alias("trusted")),
        one(requests, F.count(F.lit(1)).alias("requests"), F.count_if(F.expr("approved is null")).alias("pending")),
        one(audits, F.count(F.lit(1)).alias("audits")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # one row each
    return out


def active_keys(licenses: DataFrame, keys: DataFrame, features: DataFrame) -> DataFrame:
    """Licences that aren't deleted, with the count of their live keys and their known features; none means basic."""
    live = keys.where("active and record_state = 'active'").groupBy("license_id").agg(F.count(F.lit(1)).alias("n"))
    known = features.where(F.col("feature_name").isin(*FEATURES)).groupBy("license_id").agg(F.array_join(F.array_sort(F.collect_set("feature_name")), ",").alias("f"))
    return licenses.where("record_state <> 'deleted'").join(live, "license_id", "left").join(known, "license_id", "left").select("license_id", F.coalesce("n", F.lit(0)).alias("active_keys"), F.coalesce("f", F.lit("basic")).alias("features"))


def key_lookup(keys: DataFrame, licenses: DataFrame) -> DataFrame:
    """Keys that may be used: key and licence are neither deleted nor switched off."""
    return keys.where("active and record_state <> 'deleted'").join(licenses.where("record_state <> 'deleted'").select("license_id", "owner"), "license_id").select("key_value", "license_id", "owner", "record_state")


def latest_request(requests: DataFrame) -> DataFrame:
    """The newest live request of each licence and device; ties go to the larger id."""
    w = Window.partitionBy("license_id", "device").orderBy(F.desc("created"), F.desc("request_id"))
    return requests.where("record_state = 'active'").withColumn("n", F.row_number().over(w)).where("n = 1").select("license_id", "device", "request_id", "created", "expires", "approved")


def top_list(rows: DataFrame, time: str, key: str, columns: tuple[str, ...], most: int = 200) -> DataFrame:
    """Active rows first, newest first within a state. Spark keeps only so many rows of each partition."""
    order = [state_rank(), F.desc(time), F.col(key)] if "record_state" in rows.columns else [F.desc(time), F.col(key)]
    return rows.orderBy(*order).limit(most).select(*columns)


def request_label(now: int) -> Column:
    return F.when(F.col("approved").isNotNull(), "approved").when(F.lit(now) > F.col("expires"), "expired").otherwise("pending")


def verify(keys: DataFrame, licenses: DataFrame, installs: DataFrame, requests: DataFrame, device: int, now: int) -> DataFrame:
    """What each usable key would be told on a device: the first rule that holds decides."""
    usable = key_lookup(keys, licenses).select("key_value", "license_id")
    trusted = installs.where("record_state <> 'deleted'").groupBy("license_id").agg(F.count_if(F.expr("trusted = 1")).alias("n_trusted"), F.max(F.when(F.col("device") == device, F.col("trusted"))).alias("own"))
    last = latest_request(requests).where(F.col("device") == device).select("license_id", "expires", "approved", "request_id")
    rule = (
        F.when(F.coalesce("n_trusted", F.lit(0)) == 0, "V1").when(F.col("own") == 1, "V2").when(F.col("approved").isNotNull(), "V3")
        .when(F.col("request_id").isNotNull() & (F.lit(now) >= F.col("expires")), "V4").when(F.col("request_id").isNotNull(), "V5").otherwise("V6")
    )
    outcome = F.when(F.col("rule").isin("V1", "V2", "V3"), "active").when(F.col("rule") == "V4", "replacement_issued").otherwise("pending_confirmation")
    return usable.join(trusted, "license_id", "left").join(last, "license_id", "left").withColumn("rule", rule).select("key_value", "license_id", "rule", outcome.alias("outcome"))


def soft_delete(tables: dict[str, DataFrame], chosen: Column) -> DataFrame:
    """Rows of every table by state after the licences chosen are deleted along with what hangs on them."""
    out = None
    for name, df in tables.items():
        new = df.withColumn("record_state", F.when(chosen, "deleted").otherwise(F.col("record_state"))).groupBy("record_state").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "record_state", "n")
        out = new if out is None else out.unionByName(new)
    return out


def upsert_installations(old: DataFrame, new: DataFrame) -> DataFrame:
    """Merges sightings by licence and device: first_seen and id stay, last_seen and trust move on."""
    fresh = new.groupBy("license_id", "device").agg(F.min("seen").alias("lo"), F.max("seen").alias("hi"))
    m = old.join(fresh, ["license_id", "device"], "full")
    return m.select("license_id", "device", F.coalesce("installation_id", F.concat_ws("-", F.col("license_id").cast("string"), F.col("device").cast("string"))).alias("installation_id"), F.coalesce("first_seen", "lo").alias("first_seen"), F.coalesce("hi", "last_seen").alias("last_seen"), F.coalesce("trusted", F.lit(0)).alias("trusted"))


def notification_fold(mails: DataFrame) -> DataFrame:
    """Per licence the furthest state that its notifications reached, and when each state was first reached."""
    rank = F.element_at(F.create_map(*[F.lit(x) for k, s in enumerate(("queued", "sent", "delivered", "read")) for x in (s, k)]), F.col("state"))
    first = lambda s: F.min(F.when(F.col("state") == s, F.col("created"))).alias(f"{s}_at")
    return mails.groupBy("license_id").agg(F.max_by("state", rank).alias("state"), first("sent"), first("delivered"), first("read"), F.count(F.lit(1)).alias("n"))


def normalise_features(raw: DataFrame, column: str) -> Column:
    """A comma list as known features: trimmed, lower case, dashes as underscores, basic always in, sorted, each once."""
    parts = F.transform(F.split(F.lower(F.col(column)), ","), lambda x: F.replace(F.trim(x), F.lit("-"), F.lit("_")))
    return F.array_join(F.array_sort(F.array_union(F.filter(parts, lambda x: x.isin(*FEATURES)), F.array(F.lit("basic")))), ",")


def set_once(mails: DataFrame, now: int) -> DataFrame:
    """Sent times are kept where they are set, and set to now where a mail is past the queue."""
    sent = F.when(F.col("state") != "queued", F.coalesce(F.when(F.col("created") % 120 == 0, F.col("created")), F.lit(now)))
    return mails.select("email_id", "state", sent.cast("long").alias("sent_at"))


def read_and_mark(mails: DataFrame) -> DataFrame:
    """The notifications that a reader gets (sent or delivered), oldest first within a licence, with the state that they have afterwards."""
    w = Window.partitionBy("license_id").orderBy("created", "email_id")
    return mails.where(F.col("state").isin("sent", "delivered")).select("license_id", "email_id", F.row_number().over(w).cast("long").alias("place"), F.lit("read").alias("state"))


def switch_keys(keys: DataFrame, chosen: Column, active: bool) -> DataFrame:
    """Keys after the chosen ones are switched; deleted keys stay as they are."""
    return keys.select("key_id", F.when(chosen & (F.col("record_state") != "deleted"), F.lit(active)).otherwise(F.col("active")).alias("active"), "record_state")


def replace_features(old: DataFrame, new: DataFrame) -> DataFrame:
    """Feature sets after those of some licences are replaced: their old rows go, the new ones come, each once."""
    kept = old.join(new.select("license_id").distinct(), "license_id", "left_anti")
    return kept.select("license_id", "feature_name").unionByName(new.select("license_id", "feature_name").distinct())


def playback_fallback(requests: DataFrame, keys: DataFrame) -> DataFrame:
    """The licence of each playback request: that of the key it names, or else the one it claims."""
    return requests.join(keys.select(F.col("key_id").alias("request_id"), F.col("license_id").alias("of_key")), "request_id", "left").select("request_id", "codec", F.coalesce("of_key", "license_id").alias("license_id"))


def audit_lines(events: DataFrame) -> DataFrame:
    """Audit rows with a JSON payload; fields that are null are left out of it."""
    doc = F.to_json(F.struct(F.col("event_type").alias("type"), F.when(F.col("license_id") % 2 == 0, F.col("license_id")).alias("license")))
    return events.select("event_id", F.length(doc).cast("long").alias("n"), F.get_json_object(doc, "$.type").alias("type"), F.get_json_object(doc, "$.license").cast("long").alias("license"))


def issue_replacements(requests: DataFrame, now: int) -> DataFrame:
    """A new licence for each that has an expired, unapproved request: the newest such request names it."""
    late = requests.where((F.col("expires") <= now) & F.col("approved").isNull() & (F.col("record_state") == "active"))
    return late.groupBy("license_id").agg(F.max("request_id").alias("request_id"), F.count(F.lit(1)).alias("n")).select("license_id", F.concat(F.lit("R-"), F.col("license_id").cast("string"), F.lit("-"), F.col("request_id").cast("string")).alias("replacement"), "n")
