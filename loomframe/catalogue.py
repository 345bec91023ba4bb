"""The queries of the library itself: operators bound to relations."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.functions import codecs
from loomframe.operators import admin, kernels, metrics, packets, picks, playback, relational, reports, tiles
from loomframe.plans.oracles import ORACLE_SQL as _SQL
from loomframe.plans.relations import relation
from loomframe.sources import container, raw

Query = Callable[[SparkSession, str], DataFrame]

FLAGSHIP = "pareto_smallest_bytes"
#: The moment at which requests are judged, and the device that asks.
NOW, DEVICE = 1_706_000_000, 1
PATTERNS = ("square", "ramp", "bars", "checker")


def over(f: Callable[..., DataFrame], *names: str, **options) -> Query:
    """An operator over relations."""
    return lambda spark, sf_dir: f(*[relation(spark, sf_dir, n) for n in names], **options)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def each_pattern(measure: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        clips = [(p, metrics.clip(spark, p, 64, 64, 4)) for p in PATTERNS]
        return reduce(DataFrame.unionByName, [measure(c, metrics.quantised(c, 16)).select(F.lit(p).alias("pattern"), "*") for p, c in clips])

    return run


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An hourly seek on every track."""
    hours = spark.range(720).select(F.col("id").alias("h"))
    return relation(spark, sf_dir, "tracks").crossJoin(F.broadcast(hours)).select("track_id", (F.col("h") * 3600 * F.col("timescale")).alias("target"))


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernels.quantise(tiles.dct(relation(spark, sf_dir, "tiles")), 16)


def top(table: str, time: str, key: str, *columns: str) -> Query:
    return lambda spark, sf_dir: relational.top_list(relation(spark, sf_dir, table), time, key, columns)


def top_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = relational.top_list(relation(spark, sf_dir, "verification_requests"), "created", "request_id", ("request_id", "license_id", "created", "expires", "approved", "record_state"))
    return rows.withColumn("label", relational.request_label(NOW))


def cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("licenses", "license_keys", "installations", "verification_requests", "audit_events")
    return relational.soft_delete({n: relation(spark, sf_dir, n).select("license_id", "record_state") for n in names}, F.col("license_id") % 7 == 0)


def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = relation(spark, sf_dir, "audit_events").where("event_id % 10 = 3").select("license_id", (F.col("event_id") % 6).alias("device"), F.col("created").alias("seen"))
    return relational.upsert_installations(relation(spark, sf_dir, "installations"), new)


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.expr("case p_partkey % 4 when 0 then ' Editor, BATCH ,x' when 1 then 'import,import' when 2 then p_name else 'export, basic' end")
    parts = read(spark, sf_dir, "part").withColumn("raw", raw)
    return parts.select(F.col("p_partkey").alias("part"), relational.normalise_features(parts, "raw").alias("features"))


def gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = relation(spark, sf_dir, "packets")
    return packets.missing(p, p.where("sequence % 5 = 0").select("track_id", (F.col("sequence") + 3).alias("sequence")))


def square(spark: SparkSession) -> DataFrame:
    return kernels.motion(metrics.clip(spark, "square", 64, 64, 4), 2, 64, 64)


def replaced_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = relation(spark, sf_dir, "license_features")
    new = relation(spark, sf_dir, "licenses").where("license_id % 9 = 0").select("license_id", F.explode(F.array(F.lit("basic"), F.lit("batch"))).alias("feature_name"))
    return relational.replace_features(old, new)


def json_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = lambda path: F.coalesce(F.get_json_object("props", path).cast("long"), F.lit(0))
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(k("$.k")).alias("k"), F.sum(k("$.missing")).alias("missing"))


def json_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urgent orders as JSON documents, without null fields, read back strictly by their schema."""
    doc = F.to_json(F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"), F.lit(None).cast("string").alias("note")))
    back = F.from_json("doc", "id long, status string, price double, note string", {"mode": "FAILFAST"})
    return read(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(doc.alias("doc")).select(back.alias("r")).select("r.id", "r.status", "r.price")


def label_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    finite = ~F.isnan("p_retailprice") & (F.abs("p_retailprice") < float("inf"))
    return read(spark, sf_dir, "part").agg(F.count_if(F.contains("p_name", F.lit("ring"))).alias("holds"), F.count_if(F.startswith("p_type", F.lit("ECONOMY"))).alias("starts"), F.count_if(F.lower("p_brand") == "brand#2").alias("same"), F.count_if(finite).alias("finite"), F.count_if(F.regexp_extract("p_name", "([a-z]+)$", 1) == "ring").alias("routed"))


def recency(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return read(spark, sf_dir, "conversations").where("role <> 'system'").withColumn("n", F.row_number().over(w)).where("n <= 3").select("conv_id", "turn", "role")


def strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    escaped = F.col("url")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        escaped = F.replace(escaped, F.lit(a), F.lit(b))
    return read(spark, sf_dir, "pages").select("page_id", F.sha2("url", 256).alias("digest"), F.concat(F.rtrim("url", F.lit("/")), F.lit("/api/v1")).alias("endpoint"), escaped.alias("escaped"), F.contains("url", F.lit("example")).alias("probed"))


def integers(spark: SparkSession, sf_dir: str) -> DataFrame:
    zig = F.expr("case when user_id - event_id >= 0 then 2 * (user_id - event_id) else -2 * (user_id - event_id) - 1 end")
    size = F.when(F.col("event_id") < 128, 1).when(F.col("event_id") < 16384, 2).when(F.col("event_id") < 2097152, 3).otherwise(4)
    return read(spark, sf_dir, "events").select("event_id", zig.alias("zigzag"), F.expr("event_id ^ user_id").alias("mixed"), F.expr("shiftleft(event_id, 3) & 255").alias("shifted"), size.cast("long").alias("varint_bytes"), F.expr("event_id * 30000 div 1001").alias("fps"))


def flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {"bytes_cap": "bytes > 90000", "qp_high": "qp > 28", "low_quality": "ssim < 0.95", "bad_pair": "entropy_model = 'context' and inter_syntax = 'compact'"}
    codes = F.concat_ws(",", *[F.when(F.expr(e), n) for n, e in rules.items()])
    return relation(spark, sf_dir, "sweep_rows").where("bytes > 90000 or qp > 28 or ssim < 0.95").select("clip", "line", "part", "bytes", codes.alias("codes"))


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = F.sum(F.when(F.col("ok"), F.col("bytes")))
    return relation(spark, sf_dir, "sweep_rows").groupBy("inter_partition").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.expr("ok")).alias("n_ok"), F.round(F.sum("bytes") / F.greatest(F.count_if(F.expr("ok")), F.lit(1)), 6).alias("bytes_per_ok"), F.round(F.when(good > 0, 100 * (F.sum("bytes") - good) / good), 6).alias("savings"))


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    deltas = kernels.adaptive_deltas(kernels.block_variance(relation(spark, sf_dir, "blocks")), 24)
    return reports.quality_steps(deltas, 28, 24, 32)


def extras(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("qp", "inter_syntax", "entropy_model", "cost_model", "inter_partition")
    more = relation(spark, sf_dir, "sweep_rows").where("line = 7").select(*names).distinct()
    return reports.grid_with_extras(picks.grid(spark), more)


def raw_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("o_orderkey") % 4 == 0, "frozen").when(F.col("o_orderkey") % 4 == 1, "archived").when(F.col("o_orderkey") % 4 == 2, None).otherwise("deleted")
    return admin.states(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key_id"), (F.col("o_orderkey") % 2).alias("raw_active"), raw.alias("raw_state")))


def issued(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = F.when(F.col("license_id") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("export"), F.lit("editor")))
    return admin.issue(relation(spark, sf_dir, "licenses").where("license_id % 10 = 0").withColumn("asked", asked), NOW)


def cascaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = {"licenses": "license_id", "license_keys": "key_id", "installations": "installation_id", "verification_requests": "request_id", "audit_events": "event_id"}
    return admin.cascade({t: (relation(spark, sf_dir, t), k) for t, k in keys.items()}, F.col("license_id") % 7 == 0, "deleted")


def migrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = relation(spark, sf_dir, "licenses").select("license_id", "owner")
    wanted = {"owner": ("string", "nobody"), "record_state": ("string", "active"), "state_changed": ("long", None)}
    return admin.migrate(old, wanted).select("license_id", "owner", "record_state", "state_changed")


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    endings = F.element_at(F.array(*map(F.lit, (".528", ".SRSM", ".mkv", ".txt", "", ".Wav"))), (F.col("page_id") % 6 + 1).cast("int"))
    return read(spark, sf_dir, "pages").select("page_id", playback.route(F.concat(F.lit("a.b/clip"), endings)).alias("route"))


def limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    kind = F.element_at(F.array(*map(F.lit, ("video", "audio", "subtitle"))), (k % 3 + 1).cast("int"))
    return playback.picture_limits(read(spark, sf_dir, "part").select(k.alias("id"), kind.alias("kind"), (k * 37 % 9_000).alias("width"), (k * 53 % 8_192).alias("height"), (k % 5 * 8_000).alias("rate"), (k % 4).alias("channels")))


def notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    mails = relation(spark, sf_dir, "email_outbox")
    return playback.unseen(mails, mails.where("email_id % 3 <> 0"), 2)


def frames(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Frames of clips (orders) and their decoded copies, some of which are missing, double or out of range."""
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("clip"), F.col("l_linenumber").cast("long").alias("frame"), F.floor("l_extendedprice").cast("long").alias("bytes"), "l_partkey")
    copies = F.when(F.col("l_partkey") % 11 == 0, F.array()).when(F.col("l_partkey") % 13 == 0, F.array(F.lit(0), F.lit(0))).when(F.col("l_partkey") % 17 == 0, F.array(F.lit(100))).otherwise(F.array(F.lit(0)))
    decoded = lines.withColumn("shift", F.explode(copies.cast("array<long>"))).select("clip", (F.col("frame") + F.col("shift")).alias("frame"), "bytes")
    return lines.select("clip", "frame"), decoded


def pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") * 7 % 1_000 + 16).alias("width"), (F.col("p_partkey") * 11 % 600 + 16).alias("height"))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    command = F.element_at(F.create_map(*[F.lit(x) for pair in playback.COMMANDS.items() for x in pair]), F.col("event_type"))
    return playback.player_states(read(spark, sf_dir, "events").select("user_id", "event_id", F.coalesce(command, F.lit("step")).alias("command")))


#: Magics of the generated files.
MAGIC, OLD_MAGIC = b"LOOMF2\0\0", b"LOOM"


def generated_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets written to files of up to 500 sequence numbers, and scanned again."""
    p = relation(spark, sf_dir, "packets")
    files = p.select(F.expr("cast(sequence div 500 as string)").alias("file"), "track_id", "flags", "sequence", "pts", F.col("pts").alias("dts"), F.col("size").cast("string").cast("binary").alias("payload"))
    made = container.mux(files, [(1, 2, 7, 90_000), (2, 1, 8, 48_000), (3, 3, 9, 1_000)], MAGIC, 32)
    return container.blocks_in(made.select(F.col("file").alias("path"), "content"), MAGIC, OLD_MAGIC)


def container_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = generated_blocks(spark, sf_dir).where("kind = 'packet'")
    return own.select(F.col("path").cast("long").alias("file"), "sequence", F.col("track_id").cast("long").alias("track_id"), F.col("flags").cast("long").alias("flags"), "pts", F.col("payload").cast("string").cast("long").alias("size"))


def container_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = generated_blocks(spark, sf_dir).where("kind <> 'packet'")
    return own.groupBy(F.col("path").cast("long").alias("file"), "kind").agg(F.count(F.lit(1)).alias("entries"), F.sum("packet_number").alias("numbers"), F.max("pts").alias("max_pts"), F.count_distinct("cue_id").alias("cues"))


def round_trip(codec: str) -> Query:
    return lambda spark, sf_dir: codecs.round_trips(relation(spark, sf_dir, "audio"), "stream", "p", "s", codec).select("stream", "n", "ok")


QUERIES: dict[str, Query] = {
    "pareto_smallest_bytes": over(picks.smallest_at_quality, "sweep_rows", ssim=0.98),
    "pareto_best_ssim": over(picks.best_under_budget, "sweep_rows", measure="ssim", budget=5000),
    "pareto_best_psnr": over(picks.best_under_budget, "sweep_rows", measure="psnr", budget=5000),
    "pareto_overall": over(picks.best_overall, "sweep_rows"),
    "closest_bitrate": over(picks.closest_rate, "sweep_rows", target=20000.0),
    "sweep_grid": lambda spark, sf_dir: picks.grid(spark),
    "sweep_grid_quick": lambda spark, sf_dir: picks.grid(spark, 24),
    "paired_partition_wins": over(picks.paired_wins, "sweep_rows"),
    "paired_modes_pivot": over(picks.paired_modes, "sweep_rows"),
    "byte_shares_bottleneck": over(picks.byte_shares, "sweep_rows"),
    "rdo_pick": over(picks.rdo_pick, "sweep_rows"),
    "psnr_clip": each_pattern(metrics.clip_psnr),
    "ssim_clip": each_pattern(lambda a, b: metrics.clip_ssim(a, b, 64, 64)),
    "snr_audio": over(metrics.snr, "audio", step=64),
    "autocorr": over(metrics.autocorrelation, "audio", order=8),
    "bitrate_report": over(metrics.bitrate, "packets", fps=30),
    "qp_histogram": over(metrics.qp_histogram, "sweep_rows"),
    "bytes_summary": over(metrics.bytes_summary, "sweep_rows"),
    "revision_pivot": over(metrics.revisions, "packets"),
    "license_snapshot_stats": over(relational.snapshot, "licenses", "license_keys", "installations", "verification_requests", "audit_events"),
    "license_active_keys": over(relational.active_keys, "licenses", "license_keys", "license_features"),
    "key_lookup": over(relational.key_lookup, "license_keys", "licenses"),
    "latest_request": over(relational.latest_request, "verification_requests"),
    "admin_top200_licenses": top("licenses", "created", "license_id", "license_id", "owner", "created", "record_state"),
    "admin_top200_keys": top("license_keys", "created", "key_id", "key_id", "license_id", "key_value", "created", "record_state"),
    "admin_top200_installations": top("installations", "last_seen", "installation_id", "installation_id", "license_id", "last_seen", "record_state"),
    "admin_top200_requests": top_requests,
    "admin_top200_audits": top("audit_events", "created", "event_id", "event_id", "license_id", "event_type", "payload", "created", "record_state"),
    "admin_top200_emails": top("email_outbox", "created", "email_id", "email_id", "license_id", "role", "created", "state"),
    "verify_decision": over(relational.verify, "license_keys", "licenses", "installations", "verification_requests", device=DEVICE, now=NOW),
    "soft_delete_cascade": cascade,
    "upsert_installation": upsert,
    "notification_fold": over(relational.notification_fold, "email_outbox"),
    "feature_normalise": features,
    "track_stats": over(packets.track_stats, "packets"),
    "container_durations": over(packets.durations, "packets", "tracks"),
    "seek_any": lambda spark, sf_dir: packets.seek(relation(spark, sf_dir, "packets"), targets(spark, sf_dir), False),
    "seek_keyframe": lambda spark, sf_dir: packets.seek(relation(spark, sf_dir, "packets"), targets(spark, sf_dir), True),
    "seek_recover_range": lambda spark, sf_dir: packets.recover_range(relation(spark, sf_dir, "packets"), targets(spark, sf_dir)),
    "cue_blocks": over(packets.cues, "packets"),
    "packet_offsets": over(packets.offsets, "packets", header=24),
    "rescale_pts": over(packets.rescale, "packets", to=44100),
    "pts_accumulate": over(packets.accumulated, "packets"),
    "gop_order": lambda spark, sf_dir: packets.gop(spark, 240, 12),
    "display_gaps": gaps,
    "codec_policy": over(packets.unsupported, "tracks"),
    "rate_control_fold": over(packets.rate_control, "packets", start=28, low=10, high=44, step=1, target=2000),
    "block_variance": over(kernels.block_variance, "blocks"),
    "adaptive_deltas": lambda spark, sf_dir: kernels.adaptive_deltas(kernels.block_variance(relation(spark, sf_dir, "blocks")), 24),
    "block_activity": lambda spark, sf_dir: kernels.activity(metrics.clip(spark, "bars", 64, 64, 4), 64, 64),
    "sad_search": lambda spark, sf_dir: square(spark),
    "half_places": lambda spark, sf_dir: kernels.half_places(metrics.clip(spark, "square", 64, 64, 4), 2, 64, 64),
    "mv_predict_delta": lambda spark, sf_dir: kernels.predicted(square(spark)),
    "dct8": over(tiles.dct, "tiles"),
    "quantise": levels,
    "zigzag_scan": lambda spark, sf_dir: spark.range(64).select(F.expr("id div 8").alias("ky"), F.expr("id % 8").alias("kx")).select("ky", "kx", kernels.zigzag_place().alias("place")),
    "residual_class": over(kernels.residual_class, "blocks"),
    "coefficient_cost": lambda spark, sf_dir: kernels.coefficient_cost(levels(spark, sf_dir)),
    "delta_runs": over(kernels.delta_runs, "blocks"),
    "rle_modes": over(kernels.run_lengths, "blocks"),
    "deblock_pass": over(kernels.deblock, "blocks"),
    "weighted_blend": over(kernels.blend, "blocks", weight=96),
    "b_blend_pick": over(kernels.blend_pick, "blocks"),
    "rgb_yuv": over(kernels.luma_chroma, "blocks"),
    "json_path_default": json_defaults,
    "report_json_build": json_reports,
    "label_filters": label_filters,
    "bounded_recency": recency,
    "string_helpers": strings,
    "int_helpers": integers,
    "validation_flags": flags,
    "telemetry_rollup": telemetry,
    "notification_sent_once": over(relational.set_once, "email_outbox", now=NOW),
    "notification_read": over(relational.read_and_mark, "email_outbox"),
    "key_switch": lambda spark, sf_dir: relational.switch_keys(relation(spark, sf_dir, "license_keys"), F.col("license_id") % 5 == 0, False),
    "feature_replace": replaced_features,
    "playback_license": over(relational.playback_fallback, "playback_requests", "license_keys"),
    "audit_payloads": over(relational.audit_lines, "audit_events"),
    "replacement_licenses": over(relational.issue_replacements, "verification_requests", now=NOW),
    "reference_slots": over(packets.reference_slots, "packets"),
    "key_neighbours": over(packets.neighbours, "packets"),
    "codec_playable": over(packets.playable, "tracks"),
    "primary_rows": over(picks.primary, "sweep_rows", wanted="auto-fast"),
    "compression_ratios": over(picks.ratios, "sweep_rows", raw=6_144),
    **{f"{c}_round_trip": round_trip(c) for c in ("varint", "rans", "contexts", "bits", "lpc", "runs")},
    "container_packets": container_packets,
    "container_entries": container_entries,
    "preset_metadata": lambda spark, sf_dir: raw.metadata(raw.presets(spark)),
    "ordered_keys": over(admin.ordered_keys, "license_keys"),
    "feature_gate": over(admin.allowed, "licenses", "license_features", feature="editor"),
    "feature_slugs": over(admin.slugs, "license_features"),
    "state_defaults": raw_states,
    "unknown_licenses": lambda spark, sf_dir: admin.unknown_licenses(relation(spark, sf_dir, "playback_requests"), relation(spark, sf_dir, "licenses").where("record_state <> 'deleted'")),
    "license_issue": issued,
    "cascade_rows": cascaded,
    "key_state_audit": lambda spark, sf_dir: admin.set_state(relation(spark, sf_dir, "license_keys"), F.col("key_id") % 6 == 0, "archived"),
    "request_approve": lambda spark, sf_dir: admin.approve(relation(spark, sf_dir, "verification_requests"), F.col("request_id") % 4 == 0, NOW),
    "schema_migrate": migrated,
    "label_first_min": over(reports.first_min, "sweep_rows", label="rdo"),
    "clip_candidates": over(reports.candidates, "sweep_rows"),
    "syntax_pairs": over(reports.syntax_pairs, "sweep_rows"),
    "grid_with_extras": extras,
    "b_modes": over(reports.b_modes, "sweep_rows"),
    "rate_report": over(reports.rate_report, "sweep_rows", fps=30, target_kbps=9_000),
    "quality_steps": steps,
    "quality_steps_merged": lambda spark, sf_dir: reports.merged_steps(steps(spark, sf_dir)),
    "still_or_searched": over(reports.still_or_searched, "sweep_rows"),
    "decision_counters": lambda spark, sf_dir: reports.decisions(reports.still_or_searched(relation(spark, sf_dir, "sweep_rows"))),
    "vector_statistics": lambda spark, sf_dir: reports.vector_statistics(kernels.predicted(square(spark))),
    "motion_telemetry": lambda spark, sf_dir: reports.motion_telemetry(square(spark)),
    "activity_scores": lambda spark, sf_dir: reports.activity_scores(kernels.activity(metrics.clip(spark, "bars", 64, 64, 4), 64, 64)),
    "side_bytes": over(reports.side_bytes, "sweep_rows"),
    "report_sentences": over(reports.sentences, "sweep_rows"),
    "report_markdown": over(reports.markdown, "sweep_rows"),
    "encoder_listed": lambda spark, sf_dir: read(spark, sf_dir, "part").select("p_partkey", reports.lists_encoder(F.col("p_name"), "ring").alias("listed")),
    "path_routes": routes,
    "picture_limits": limits,
    "silent_tracks": lambda spark, sf_dir: playback.silent_tracks(relation(spark, sf_dir, "tracks"), relation(spark, sf_dir, "packets").where("track_id <> 2")),
    "notices_unseen": notices,
    "frame_pairs": lambda spark, sf_dir: playback.paired_frames(*frames(spark, sf_dir)),
    "display_order": lambda spark, sf_dir: playback.display_order(frames(spark, sf_dir)[1], 5),
    "ticks_of_ms": over(playback.ticks, "packets", "tracks"),
    "skip_budget": over(playback.skips, "packets", track=1, per=1_000, budget=8),
    "player_states": sessions,
    "interleaved": over(playback.interleaved, "audio"),
    "superchunk_grid": lambda spark, sf_dir: playback.superchunks(pictures(spark, sf_dir)),
    "superchunk_regions": lambda spark, sf_dir: playback.regions(pictures(spark, sf_dir)),
    "idct8": over(tiles.idct, "tiles"),
    "dct4": over(tiles.dct4, "tiles"),
    "deblock_plane": over(tiles.deblock, "tiles"),
    "intra_pick": over(tiles.intra, "tiles"),
    "transform_choice": over(tiles.transform_choice, "tiles"),
    "scan_orders": over(tiles.scans, "tiles"),
    "residual_tokens": over(tiles.tokens, "tiles"),
    "coefficient_bytes": over(tiles.coefficient_bytes, "tiles"),
    "colour_planes": over(tiles.colours, "tiles"),
}

ORACLE_SQL: dict[str, str] = {k: v for k, v in _SQL.items() if k in QUERIES}
