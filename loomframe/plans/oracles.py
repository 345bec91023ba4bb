"""DuckDB SQL for the rows of the queries, written apart from the Spark plans."""

from __future__ import annotations

from loomframe.plans.relations import oracle

RANK = "case record_state when 'active' then 0 when 'archived' then 1 else 2 end"
VALID = "ok and bytes is not null"
USABLE = "select k.key_value, k.license_id, l.owner, k.record_state from license_keys k join licenses l using (license_id) where k.active and k.record_state <> 'deleted' and l.record_state <> 'deleted'"
LATEST = "select * from (select *, row_number() over (partition by license_id, device order by created desc, request_id desc) as n from verification_requests where record_state = 'active') where n = 1"


def top(table: str, time: str, key: str, columns: str, state: bool = True) -> str:
    return f"select {columns} from {table} order by {RANK + ',' if state else ''} {time} desc, {key} limit 200"


def clip(name: str, width: int = 64, height: int = 64, frames: int = 4) -> str:
    value = {
        "square": f"case when x >= frame * 8 % {width - 32} and x < frame * 8 % {width - 32} + 32 and y >= frame * 4 % {height - 32} and y < frame * 4 % {height - 32} + 32 then 220 else 16 end",
        "ramp": "(x + frame * 3) % 256",
        "bars": f"(case when (y + frame * 7 % {height}) % 64 < 32 then 200 else 40 end + x % 16) % 256",
        "checker": "case when (x // 8 + y // 8 + frame) % 2 = 0 then 240 else 20 end",
    }[name]
    return f"select frame, y, x, cast({value} as bigint) as v from (select f as frame, yy as y, xx as x from range({frames}) a(f), range({height}) b(yy), range({width}) c(xx))"


COARSE = "least(v // 16 * 16 + 8 + (x + y) % 3, 255)"
PAIRED = f"select '{{0}}' as pattern, frame, y, x, v, {COARSE} as m from ({{1}})"
CLIPS = " union all ".join(PAIRED.format(p, clip(p)) for p in ("square", "ramp", "bars", "checker"))
SSIM = """(2.0 * (r / 64.0) * (m / 64.0) + 6.5025) * (2.0 * (rm / 64.0 - (r / 64.0) * (m / 64.0)) + 58.5225)
  / (((r / 64.0) * (r / 64.0) + (m / 64.0) * (m / 64.0) + 6.5025) * (greatest(rr / 64.0 - (r / 64.0) * (r / 64.0), 0) + greatest(mm / 64.0 - (m / 64.0) * (m / 64.0), 0) + 58.5225))"""
SEEK = """select t.track_id, t.target, p.pts, p.sequence from (select track_id, cast(h * 3600 as bigint) * timescale as target from tracks, range(720) r(h)) t
  asof left join (select track_id, pts, max(sequence) as sequence from packets {0} group by track_id, pts) p on t.track_id = p.track_id and t.target >= p.pts"""
SAD = f"""with px as ({clip("square")}), g as (select mx, my from range(-2, 3) a(mx), range(-2, 3) b(my)),
  s as (select c.frame, c.y // 16 as "by", c.x // 16 as bx, g.mx, g.my, sum(abs(c.v - coalesce(p.v, 128))) as sad from px c cross join g
    left join px p on p.frame = c.frame - 1 and p.y = c.y + g.my and p.x = c.x + g.mx where c.frame > 0 group by all),
  best as (select frame, "by", bx, cast(mx as bigint) as mvx, cast(my as bigint) as mvy, cast(sad as bigint) as sad from s qualify row_number() over (partition by frame, "by", bx order by sad, mx, my) = 1)"""
VARIANCE = "select block, s // 64 as mean, q // 64 - (s // 64) * (s // 64) as variance from (select block, cast(sum(v) as bigint) as s, cast(sum(v * v) as bigint) as q from blocks group by block)"
DCT = """select block, ky, kx, round(sum(v * bx.c * b2.c), 6) as c from blocks
  join (select n, k as kx, case when k = 0 then sqrt(0.5) else 1 end / sqrt(8) * cos(pi() / 16 * k * (2 * n + 1)) as c from range(8) a(n), range(8) b(k)) bx on bx.n = x
  join (select n, k as ky, case when k = 0 then sqrt(0.5) else 1 end / sqrt(8) * cos(pi() / 16 * k * (2 * n + 1)) as c from range(8) a(n), range(8) b(k)) b2 on b2.n = y group by block, ky, kx"""
LEVELS = f"select block, ky, kx, w, (w + 8 * cast(sign(w) as bigint)) // 16 as level from (select block, ky, kx, cast(case when c < 0 then -floor(-c + 0.500001) else floor(c + 0.500001) end as bigint) as w from ({DCT}))"
PLACE = "case when ky + kx < 8 then (ky + kx) * (ky + kx + 1) // 2 else 64 - (15 - ky - kx) * (16 - ky - kx) // 2 end + case when (ky + kx) % 2 = 0 then kx - greatest(ky + kx - 7, 0) else ky - greatest(ky + kx - 7, 0) end"
TRIO = "select block // 3 as trio, p, max(v) filter (block % 3 = 0) as a, max(v) filter (block % 3 = 1) as b, max(v) filter (block % 3 = 2) as c from blocks group by all having count(*) = 3"
GOP = "select f as frame, f % 12 = 0 as i, f % 12 <> 0 and f % 2 = 1 and f + 1 < 240 as b from range(240) r(f)"

SQL = {
    "pareto_smallest_bytes": f"select clip, line, part, qp, bytes, ssim, psnr from sweep_rows where {VALID} and ssim >= 0.98 order by bytes, clip, line, part limit 1",
    "pareto_best_ssim": f"select clip, line, part, qp, bytes, ssim, psnr from sweep_rows where {VALID} and bytes <= 5000 order by ssim desc, bytes, clip desc, line desc, part desc limit 1",
    "pareto_best_psnr": f"select clip, line, part, qp, bytes, ssim, psnr from sweep_rows where {VALID} and bytes <= 5000 order by psnr desc, bytes, clip desc, line desc, part desc limit 1",
    "pareto_overall": f"select clip, line, part, qp, bytes, ssim, psnr from sweep_rows where {VALID} order by ssim desc, psnr desc, bytes desc, clip desc, line desc, part desc limit 1",
    "closest_bitrate": f"select qp, bytes, clip, line, round(100 * (bytes - 20000.0) / 20000.0, 6) as error_percent from sweep_rows where {VALID} qualify row_number() over (partition by qp order by abs(bytes - 20000.0), line, bytes, clip, part) = 1",
    "sweep_grid": "select cast(qp as bigint) as qp, s as inter_syntax, m as entropy_model, c as cost_model, p as inter_partition from (values (18), (22), (26), (30), (34)) a(qp), (values ('compact'), ('entropy')) b(s), (values ('static'), ('context')) d(m), (values ('header-aware'), ('rdo-fast')) e(c), (values ('fixed16x16'), ('auto-fast')) f(p) where m <> 'context' or s = 'entropy'",
    "paired_partition_wins": f"""select count(*) as compared, count_if(auto < fixed) as auto_wins, count_if(auto > fixed) as fixed_wins, count_if(auto = fixed) as equal, cast(sum(auto - fixed) as bigint) as delta from (
      select max(bytes) filter (inter_partition = 'fixed16x16') as fixed, max(bytes) filter (inter_partition = 'auto-fast') as auto from (
        select * from sweep_rows where {VALID} qualify row_number() over (partition by clip, inter_syntax, qp, entropy_model, cost_model, inter_partition order by line desc, part desc, bytes desc) = 1)
      group by clip, inter_syntax, qp, entropy_model, cost_model) where fixed is not null and auto is not null""",
    "paired_modes_pivot": f"""select qp, count(*) as compared, count_if(c < s) as lower, count_if(c > s) as higher, count_if(c = s) as equal, cast(sum(c - s) as bigint) as delta from (
      select qp, min(bytes) filter (entropy_model = 'static') as s, min(bytes) filter (entropy_model = 'context') as c from sweep_rows where {VALID} group by clip, qp, cost_model, inter_partition) where s is not null and c is not null group by qp""",
    "byte_shares_bottleneck": """with s as (select qp, cast(sum(bytes * 8) as bigint) as total, cast(sum(bytes * 5) as bigint) as residual, cast(sum(bytes * 2) as bigint) as intra, cast(sum(part % 1000) as bigint) as motion, cast(sum(line * 20) as bigint) as header from sweep_rows group by qp),
      u as (select qp, total, 0 as k, 'residual' as bucket, residual as bytes from s union all select qp, total, 1, 'intra', intra from s union all select qp, total, 2, 'motion', motion from s union all select qp, total, 3, 'header', header from s union all select qp, total, 4, 'unaccounted', greatest(total - residual - intra - motion - header, 0) from s)
      select qp, bucket, bytes, round(bytes / greatest(total, 1), 6) as share, first_value(bucket) over (partition by qp order by bytes desc, k) as bottleneck from u""",
    "rdo_pick": f"""select clip, line, part, qp, lam, cost from (select *, cast(floor((1 - ssim) * 1000000 + 0.5) as bigint) + lam * greatest(bytes, 0) // 256 as cost from (
      select *, 217 * (case when e >= 0 then 256 << e else 256 >> -e end) // 256 as lam from (select *, least(greatest(cast((qp - 12) // 3 as integer), -8), 16) as e from sweep_rows where {VALID}))) qualify row_number() over (partition by clip order by cost, line, part, bytes) = 1""",
    "psnr_clip": f"select pattern, count(*) as pixels, cast(sum((v - m) * (v - m)) as bigint) as squares, round(sum((v - m) * (v - m)) / count(*), 6) as mse, case when sum((v - m) * (v - m)) = 0 then 100.0 else round(10 * log10(65025.0 / (sum((v - m) * (v - m)) / count(*))), 6) end as psnr from ({CLIPS}) group by pattern",
    "ssim_clip": f"""select pattern, count(*) as frames, round(avg(s), 6) as ssim from (select pattern, frame, avg({SSIM}) as s from (
      select pattern, frame, sum(v) as r, sum(m) as m, sum(v * v) as rr, sum(m * m) as mm, sum(v * m) as rm from ({CLIPS}) group by pattern, frame, y // 8, x // 8) group by pattern, frame) group by pattern""",
    "snr_audio": "select stream, signal, noise, case when noise = 0 then 100.0 when signal = 0 then 0.0 else round(10 * log10(signal / noise), 6) end as snr from (select stream, cast(sum(s * s) as bigint) as signal, cast(sum((s - s // 64 * 64) * (s - s // 64 * 64)) as bigint) as noise from audio group by stream)",
    "autocorr": "select a.stream, cast(a.p - b.p as bigint) as lag, cast(sum(a.s * b.s) as bigint) as r from audio a join audio b on a.stream = b.stream and a.p - b.p between 0 and 8 group by a.stream, a.p - b.p",
    "bitrate_report": "select track_id, cast(sum(size) as bigint) as bytes, count(*) as frames, round(sum(size) * 8.0 * 30 / count(*), 6) as bitrate, round(sum(size) / greatest(count_if(flags % 2 = 1), 1), 6) as bytes_per_key, round(sum(size) / count(*), 6) as average from packets group by track_id",
    "qp_histogram": "select clips, string_agg('qp' || qp || ':' || n, ', ' order by qp) as histogram from (select clip // 1000 as clips, qp, count(*) as n from sweep_rows group by all) group by clips",
    "bytes_summary": "select qp, cast(sum(bytes) as bigint) as total, min(bytes) as low, max(bytes) as high, round(avg(bytes), 6) as average, round(coalesce(avg(bytes) filter (ok), 0.0), 6) as average_ok from sweep_rows group by qp",
    "revision_pivot": "select track_id, " + ", ".join(f"count_if(size % 38 = {k}) as rev{k}" for k in (1, 2, 3, 7, 10, 29, 33)) + ", count_if(size % 38 > 33 or size % 38 = 0) as outside from packets group by track_id",
    "license_snapshot_stats": """select (select count(*) from licenses) as licenses, (select count(*) from license_keys) as keys, (select count_if(active) from license_keys) as active_keys, (select count(*) from installations) as installations,
      (select count_if(trusted = 1) from installations) as trusted, (select count(*) from verification_requests) as requests, (select count_if(approved is null) from verification_requests) as pending, (select count(*) from audit_events) as audits""",
    "license_active_keys": """select l.license_id, (select count(*) from license_keys k where k.license_id = l.license_id and active and k.record_state = 'active') as active_keys,
      coalesce((select string_agg(feature_name, ',' order by feature_name) from license_features f where f.license_id = l.license_id and feature_name in ('basic', 'editor', 'import', 'export', 'batch')), 'basic') as features from licenses l where record_state <> 'deleted'""",
    "key_lookup": USABLE,
    "latest_request": f"select license_id, device, request_id, created, expires, approved from ({LATEST})",
    "admin_top200_licenses": top("licenses", "created", "license_id", "license_id, owner, created, record_state"),
    "admin_top200_keys": top("license_keys", "created", "key_id", "key_id, license_id, key_value, created, record_state"),
    "admin_top200_installations": top("installations", "last_seen", "installation_id", "installation_id, license_id, last_seen, record_state"),
    "admin_top200_requests": f"select *, case when approved is not null then 'approved' when 1706000000 > expires then 'expired' else 'pending' end as label from ({top('verification_requests', 'created', 'request_id', 'request_id, license_id, created, expires, approved, record_state')})",
    "admin_top200_audits": top("audit_events", "created", "event_id", "event_id, license_id, event_type, payload, created, record_state"),
    "admin_top200_emails": top("email_outbox", "created", "email_id", "email_id, license_id, role, created, state", False),
    "verify_decision": f"""with u as ({USABLE}), t as (select license_id, count_if(trusted = 1) as n, max(trusted) filter (device = 1) as own from installations where record_state <> 'deleted' group by license_id), r as (select * from ({LATEST}) where device = 1),
      d as (select key_value, license_id, case when coalesce(t.n, 0) = 0 then 'V1' when own = 1 then 'V2' when approved is not null then 'V3' when request_id is not null and 1706000000 >= expires then 'V4' when request_id is not null then 'V5' else 'V6' end as rule from u left join t using (license_id) left join r using (license_id))
      select *, case when rule in ('V1', 'V2', 'V3') then 'active' when rule = 'V4' then 'replacement_issued' else 'pending_confirmation' end as outcome from d""",
    "soft_delete_cascade": " union all ".join(f"select '{t}' as table_name, case when license_id % 7 = 0 then 'deleted' else record_state end as record_state, count(*) as n from {t} group by 2" for t in ("licenses", "license_keys", "installations", "verification_requests", "audit_events")),
    "upsert_installation": """select coalesce(i.license_id, n.license_id) as license_id, coalesce(i.device, n.device) as device, coalesce(installation_id, n.license_id || '-' || n.device) as installation_id, coalesce(first_seen, lo) as first_seen, coalesce(hi, last_seen) as last_seen, coalesce(trusted, 0) as trusted
      from installations i full join (select license_id, event_id % 6 as device, min(created) as lo, max(created) as hi from audit_events where event_id % 10 = 3 group by all) n on i.license_id = n.license_id and i.device = n.device""",
    "notification_fold": """select license_id, max_by(state, case state when 'queued' then 0 when 'sent' then 1 when 'delivered' then 2 else 3 end) as state, min(created) filter (state = 'sent') as sent_at, min(created) filter (state = 'delivered') as delivered_at, min(created) filter (state = 'read') as read_at, count(*) as n from email_outbox group by license_id""",
    "feature_normalise": """select p_partkey as part, array_to_string(list_sort(list_distinct(list_append(list_filter(list_transform(string_split(lower(raw), ','), lambda x: replace(trim(x), '-', '_')), lambda x: x in ('basic', 'editor', 'import', 'export', 'batch')), 'basic'))), ',') as features
      from (select p_partkey, case p_partkey % 4 when 0 then ' Editor, BATCH ,x' when 1 then 'import,import' when 2 then p_name else 'export, basic' end as raw from part)""",
    "track_stats": "select track_id, count(*) as packets, min(pts) as min_pts, max(pts) as max_pts, count_if(flags & 1 <> 0) as keyframes, count_if(flags & 16 <> 0) as corrupt, cast(sum(size) as bigint) as bytes, min(sequence) as first, max(sequence) as last from packets group by track_id",
    "container_durations": "select max(pts) // 1000 as probed_ms, max(pts * 1000 // timescale) as inspected_ms, max(pts) * 1000 // (select min_by(timescale, track_id) from tracks) as playback_ms from packets join tracks using (track_id)",
    "seek_any": SEEK.format(""),
    "seek_keyframe": SEEK.format("where flags & 1 <> 0"),
    "seek_recover_range": f"""with k as ({SEEK.format("where flags & 1 <> 0")}) select k.track_id, k.target, k.pts as from_pts, count(*) as packets, cast(sum(size) as bigint) as bytes from k join packets p on p.track_id = k.track_id and p.pts between k.pts and k.target group by all""",
    "cue_blocks": "select track_id, cue, count(*) as entries, min(sequence) as first, max(sequence) as last, max(pts) as max_pts from (select *, (row_number() over (partition by track_id order by sequence) - 1) // 32 as cue from packets) group by track_id, cue",
    "packet_offsets": "select track_id, sequence, row_number() over w - 1 as number, cast(coalesce(sum(size) over (w rows between unbounded preceding and 1 preceding), 0) + 24 as bigint) as file_offset from packets window w as (partition by track_id order by sequence)",
    "rescale_pts": "select track_id, sequence, greatest(us * 44100 // 1000000, 0) as ticks, us // 1000 as ms from packets",
    "pts_accumulate": "select track_id, sequence, cast(coalesce(sum(size) over (partition by track_id order by sequence rows between unbounded preceding and 1 preceding), 0) as bigint) as pts from packets",
    "gop_order": f"""with g as ({GOP}) select frame, case when i then 'I' when b then 'B' else 'P' end as kind, case when not i then (select max(frame) from g h where h.frame < g.frame and not h.b) end as prev_anchor, case when b then (select min(frame) from g h where h.frame > g.frame and not h.b) end as next_anchor,
      row_number() over (order by case when b then (select min(frame) from g h where h.frame > g.frame and not h.b) + 0.5 else frame end) - 1 as encode_at from g""",
    "display_gaps": "select e.track_id, e.sequence from (select track_id, sequence + 3 as sequence from packets where sequence % 5 = 0) e anti join packets p on e.track_id = p.track_id and e.sequence = p.sequence",
    "codec_policy": "select coalesce(string_agg(track_id || ':' || codec, ', ' order by track_id) filter (codec not in ('native_video', 'native_audio', 'pcm')), '') as unsupported, count_if(codec not in ('native_video', 'native_audio', 'pcm')) as n, count_if(codec not in ('native_video', 'native_audio', 'pcm')) = 0 as convertible from tracks",
    "rate_control_fold": """with p as (select track_id, row_number() over (partition by track_id order by sequence) as k, case when size > g then 1 when size < g then -1 else 0 end as d from (select *, case when flags & 1 <> 0 then 6000 else 2000 end as g from packets)),
      f as (select track_id, cast(0 as bigint) as k, cast(28 as bigint) as qp from p group by track_id union all select f.track_id, p.k, greatest(10, least(44, f.qp + p.d)) from f join p on p.track_id = f.track_id and p.k = f.k + 1)
      select track_id, k as packets, qp from f qualify row_number() over (partition by track_id order by k desc) = 1""",
    "block_variance": VARIANCE,
    "adaptive_deltas": f"""with v as ({VARIANCE}), m as (select cast(floor(quantile_cont(variance, 0.5)) as bigint) as med from v) select block, variance, least(greatest(((variance - med) * 24) // (greatest(med, 1) * 4 + 1), -6), 6) as frame_delta, least(greatest((-(variance - greatest(med, 1)) * 24) // (greatest(med, 1) * 4 + 1), -6), 6) as block_delta from v, m""",
    "block_activity": f"""with px as ({clip("bars")}), g as (select frame, y, x, v, case when x % 16 between 1 and 14 and y % 16 between 1 and 14 then abs(lead(v) over l - lag(v) over l) + abs(lead(v) over c - lag(v) over c) else 0 end as g from px window l as (partition by frame, y order by x), c as (partition by frame, x order by y)),
      s as (select frame, y // 16 as "by", x // 16 as bx, sum(v) // 256 as mean, list(v) as all_v, cast(sum(g) as bigint) as gradient from g group by all)
      select frame, "by", bx, var as variance_sum, gradient, cast(case when var < 4096 then 1024 else 0 end as bigint) as flatness from (select *, cast(list_sum(list_transform(all_v, lambda e: (e - mean) * (e - mean))) as bigint) as var from s)""",
    "sad_search": SAD + ' select frame, "by", bx, mvx, mvy, sad from best',
    "mv_predict_delta": SAD + """, d as (select a.frame, a."by", a.bx, a.mvx - list_sort([coalesce(l.mvx, 0), coalesce(u.mvx, 0), coalesce(r.mvx, 0)])[2] as dx, a.mvy - list_sort([coalesce(l.mvy, 0), coalesce(u.mvy, 0), coalesce(r.mvy, 0)])[2] as dy from best a
      left join best l on l.frame = a.frame and l."by" = a."by" and l.bx = a.bx - 1 left join best u on u.frame = a.frame and u."by" = a."by" - 1 and u.bx = a.bx left join best r on r.frame = a.frame and r."by" = a."by" - 1 and r.bx = a.bx + 1),
      z as (select *, case when dx >= 0 then 2 * dx else -2 * dx - 1 end as zx, case when dy >= 0 then 2 * dy else -2 * dy - 1 end as zy from d)
      select frame, "by", bx, dx, dy, zx, zy, cast(case when zx < 128 then 1 when zx < 16384 then 2 else 3 end + case when zy < 128 then 1 when zy < 16384 then 2 else 3 end as bigint) as bytes,
      cast(4 * case when dx = 0 then 0 when abs(dx) <= 8 then 1 when abs(dx) <= 32 then 2 else 3 end + case when dy = 0 then 0 when abs(dy) <= 8 then 1 when abs(dy) <= 32 then 2 else 3 end as bigint) as context from z""",
    "dct8": DCT,
    "quantise": f"select block, ky, kx, w, level, level * 16 as back from ({LEVELS})",
    "zigzag_scan": f"select ky, kx, {PLACE} as place from range(8) a(ky), range(8) b(kx)",
    "residual_class": """select block, nonzero, round(var, 6) as variance, case when nonzero = 0 then 'zero' when lo = hi then 'dc_only' when nonzero <= 10 and var < 120 then 'sparse' else 'dense' end as kind from (
      select block, count_if(v <> 128) as nonzero, min(v) as lo, max(v) as hi, greatest(sum((v - 128) * (v - 128)) / 64.0 - sum(v - 128) / 64.0 * (sum(v - 128) / 64.0), 0) as var from blocks group by block)""",
    "coefficient_cost": f"""select block, coalesce(max(place) filter (level <> 0), -1) as last, 2 + 3 * count_if(level <> 0 and place > 0) as cost, count_if(level <> 0 and place between 1 and 21) as low, count_if(level <> 0 and place between 22 and 42) as mid, count_if(level <> 0 and place > 42) as high from (select *, {PLACE} as place from ({LEVELS})) group by block""",
    "delta_runs": """with d as (select block, p, v - lag(v, 1, 128) over (partition by block order by p) as d from blocks), i as (select *, sum(case when d <> 0 then 1 else 0 end) over (partition by block order by p) as isle from d), r as (select block, isle, count_if(d = 0) as z from i group by all)
      select a.block, cast(sum_abs as bigint) as sum_abs, zeros, longest, runs from (select block, sum(abs(d)) as sum_abs, count_if(d = 0) as zeros from d group by block) a join (select block, max(z) as longest, count_if(z > 0) as runs from r group by block) b on a.block = b.block""",
    "rle_modes": """with m as (select block, p, v // 64 as mode, p - row_number() over (partition by block, v // 64 order by p) as isle from blocks), r as (select block, isle, mode, min(p) as start_at, count(*) as n from m group by all)
      select block, count(*) as runs, string_agg(mode || 'x' || n, ' ' order by start_at) as code from r group by block""",
    "deblock_pass": """select pair, y, a, b, case when abs(a - b) > 48 then a else (a * 224 + (a + b + 1) // 2 * 32) // 256 end as new_a, case when abs(a - b) > 48 then b else (b * 224 + (a + b + 1) // 2 * 32) // 256 end as new_b from (
      select block // 2 as pair, y, max(v) filter (block % 2 = 0 and x = 7) as a, max(v) filter (block % 2 = 1 and x = 0) as b from blocks group by all) where a is not null and b is not null""",
    "weighted_blend": "select pair, cast(sum(v) as bigint) as blended, min(v) as low, max(v) as high, cast(sum(abs(a - b)) as bigint) as sad from (select *, (a * 96 + b * 160 + 128) >> 8 as v from (select block // 2 as pair, p, max(v) filter (block % 2 = 0) as a, max(v) filter (block % 2 = 1) as b from blocks group by all) where a is not null and b is not null) group by pair",
    "b_blend_pick": f"""with t as ({TRIO}), s as (select trio, unnest([{{'k': 0, 'mode': 'average', 'sad': sum(abs(a - (b + c + 1) // 2))}}, {{'k': 1, 'mode': 'forward', 'sad': sum(abs(a - b))}}, {{'k': 2, 'mode': 'backward', 'sad': sum(abs(a - c))}},
      {", ".join(f"{{'k': {3 + k}, 'mode': 'weighted{x}', 'sad': sum(abs(a - ((b * {x} + c * {y} + 128) >> 8)))}}" for k, (x, y) in enumerate([(64, 192), (95, 161), (128, 128), (161, 95), (192, 64)]))}]) as o from t group by trio)
      select trio, o.mode as mode, cast(o.sad as bigint) as sad from s qualify row_number() over (partition by trio order by o.sad, o.k) = 1""",
    "rgb_yuv": f"""select trio, cast(sum(least(greatest(floor(l + 0.5), 0), 255)) as bigint) as y, cast(sum(least(greatest(floor((c - l) / 1.8556 + 128 + 0.5), 0), 255)) as bigint) as u, cast(sum(least(greatest(floor((a - l) / 1.5748 + 128 + 0.5), 0), 255)) as bigint) as v
      from (select *, cast(0.2126 as double) * a + cast(0.7152 as double) * b + cast(0.0722 as double) * c as l from ({TRIO})) group by trio""",
    "json_path_default": "select event_type, cast(sum(coalesce(cast(json_extract_string(props, '$.k') as bigint), 0)) as bigint) as k, cast(sum(coalesce(try_cast(json_extract_string(props, '$.missing') as bigint), 0)) as bigint) as missing from events group by event_type",
    "report_json_build": "select o_orderkey as id, o_orderstatus as status, o_totalprice as price from orders where o_orderpriority = '1-URGENT'",
    "label_filters": "select count_if(contains(p_name, 'ring')) as holds, count_if(starts_with(p_type, 'ECONOMY')) as starts, count_if(lower(p_brand) = 'brand#2') as same, count_if(isfinite(p_retailprice)) as finite, count_if(regexp_extract(p_name, '[a-z]+$') = 'ring') as routed from part",
    "bounded_recency": "select conv_id, turn, role from conversations where role <> 'system' qualify row_number() over (partition by conv_id order by turn desc) <= 3",
    "string_helpers": """select page_id, sha256(url) as digest, rtrim(url, '/') || '/api/v1' as endpoint, replace(replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') as escaped, contains(url, 'example') as probed from pages""",
    "int_helpers": "select event_id, case when d >= 0 then 2 * d else -2 * d - 1 end as zigzag, xor(event_id, user_id) as mixed, (event_id << 3) & 255 as shifted, cast(case when event_id < 128 then 1 when event_id < 16384 then 2 when event_id < 2097152 then 3 else 4 end as bigint) as varint_bytes, event_id * 30000 // 1001 as fps from (select event_id, user_id, user_id - event_id as d from events)",
    "validation_flags": """select clip, line, part, bytes, concat_ws(',', case when bytes > 90000 then 'bytes_cap' end, case when qp > 28 then 'qp_high' end, case when ssim < 0.95 then 'low_quality' end, case when entropy_model = 'context' and inter_syntax = 'compact' then 'bad_pair' end) as codes from sweep_rows where bytes > 90000 or qp > 28 or ssim < 0.95""",
    "telemetry_rollup": "select inter_partition, count(*) as n, count_if(ok) as n_ok, round(sum(bytes) / greatest(count_if(ok), 1), 6) as bytes_per_ok, round(case when sum(case when ok then bytes end) > 0 then 100 * (sum(bytes) - sum(case when ok then bytes end)) / sum(case when ok then bytes end) end, 6) as savings from sweep_rows group by inter_partition",
}
SQL |= {
    "notification_sent_once": "select email_id, state, case when state <> 'queued' then cast(case when created % 120 = 0 then created else 1706000000 end as bigint) end as sent_at from email_outbox",
    "notification_read": "select license_id, email_id, row_number() over (partition by license_id order by created, email_id) as place, 'read' as state from email_outbox where state in ('sent', 'delivered')",
    "key_switch": "select key_id, case when license_id % 5 = 0 and record_state <> 'deleted' then false else active end as active, record_state from license_keys",
    "feature_replace": "select license_id, feature_name from license_features where license_id not in (select license_id from licenses where license_id % 9 = 0) union all select license_id, unnest(['basic', 'batch']) from licenses where license_id % 9 = 0",
    "playback_license": "select r.request_id, codec, coalesce(k.license_id, r.license_id) as license_id from playback_requests r left join license_keys k on k.key_id = r.request_id",
    "audit_payloads": "select event_id, length('{\"type\":\"' || event_type || '\"' || case when license_id % 2 = 0 then ',\"license\":' || license_id else '' end || '}') as n, event_type as type, case when license_id % 2 = 0 then license_id end as license from audit_events",
    "replacement_licenses": "select license_id, 'R-' || license_id || '-' || max(request_id) as replacement, count(*) as n from verification_requests where expires <= 1706000000 and approved is null and record_state = 'active' group by license_id",
    "reference_slots": "select track_id, sequence, lag(sequence) over w as nearest, least(row_number() over w - 1, 16) as held from (select *, sum(flags & 1) over (partition by track_id order by sequence) as g from packets) window w as (partition by track_id, g order by sequence)",
    "key_neighbours": "select track_id, sequence, (select max(k.sequence) from packets k where k.track_id = p.track_id and k.flags & 1 <> 0 and k.sequence < p.sequence) as before, (select min(k.sequence) from packets k where k.track_id = p.track_id and k.flags & 1 <> 0 and k.sequence > p.sequence) as after from packets p",
    "codec_playable": "select track_id, codec, codec in ('native_video', 'native_audio', 'pcm', 'flac', 'opus', 'vorbis', 'av1', 'vp9') as free, codec in ('native_video', 'native_audio') as own from tracks",
    "primary_rows": "select clip // 500 as clips, clip, line, part, inter_partition, bytes from sweep_rows where ok qualify row_number() over (partition by clip // 500 order by inter_partition = 'auto-fast' desc, bytes, clip, line, part) = 1",
    "compression_ratios": "select qp, round(count(*) * 6144.0 / greatest(sum(bytes), 1), 6) as ratio, round(count(*) / greatest(sum(psnr), 1e-9), 6) as fps from sweep_rows group by qp",
}

NEAR = "case when {0} < 0 then -floor(-({0}) + 0.500001) else floor({0} + 0.500001) end"
WHOLE = f"select block, ky, kx, ky * 8 + kx as p, cast({NEAR.format('c')} as bigint) as w from ({DCT})"
BASIS = "(select n, k, case when k = 0 then sqrt(0.5) else 1 end / sqrt({0}) * cos(pi() / (2 * {0}) * k * (2 * n + 1)) as c from range({0}) a(n), range({0}) b(k))"
PLANE = "select block, p, v, block // 8 * 8 + y as gy, block % 8 * 8 + x as gx from blocks"
SOFT = "case when {1} is null or abs({0} - {1}) > 48 then {0} else ({0} * 224 + ({0} + {1} + 1) // 2 * 32) // 256 end"
BYTE = "cast(least(greatest(floor(round({0}, 6) + 0.5), 0), 255) as bigint)"
SQL |= {
    "idct8": f"""select w.block, y.n as y, x.n as x, round(sum(w.w * x.c * y.c), 6) as s from ({WHOLE}) w join {BASIS.format(8)} x on x.k = w.kx join {BASIS.format(8)} y on y.k = w.ky group by all""",
    "dct4": f"""with c as (select b.block, b.y // 4 * 2 + b.x // 4 as quadrant, y.k as ky, x.k as kx, round(sum(b.v * x.c * y.c), 6) as c from blocks b join {BASIS.format(4)} x on x.n = b.x % 4 join {BASIS.format(4)} y on y.n = b.y % 4 group by all),
      s as (select block, quadrant, y.n as y, x.n as x, round(sum({NEAR.format('c.c')} * x.c * y.c), 6) as s from c join {BASIS.format(4)} x on x.k = c.kx join {BASIS.format(4)} y on y.k = c.ky group by all)
      select c.block, c.quadrant, ky * 4 + kx as k, c.c, s.s from c join s on s.block = c.block and s.quadrant = c.quadrant and s.y = c.ky and s.x = c.kx""",
    "deblock_plane": f"""with q as ({PLANE}), a as (select *, case when gx % 8 = 0 then lag(v) over w when gx % 8 = 7 then lead(v) over w end as o from q window w as (partition by gy order by gx)),
      b as (select block, p, v as before, gy, gx, {SOFT.format("v", "o")} as v from a), c as (select *, case when gy % 8 = 0 then lag(v) over w when gy % 8 = 7 then lead(v) over w end as o from b window w as (partition by gx order by gy)),
      d as (select block, p, before, {SOFT.format("v", "o")} as v from c) select block, cast(sum(v * (p + 1)) as bigint) as weighted, cast(sum(abs(v - before)) as bigint) as moved from d group by block""",
    "intra_pick": """with n as (select b.block, b.v, coalesce(l.v, 128) as l, coalesce(t.v, 128) as t, coalesce(c.v, 128) as c from blocks b left join blocks l on l.block = b.block - 1 and b.block % 8 > 0 and l.x = 7 and l.y = b.y
        left join blocks t on t.block = b.block - 8 and t.y = 7 and t.x = b.x left join blocks c on c.block = b.block - 9 and b.block % 8 > 0 and c.p = 63),
      d as (select *, (sum(l) over (partition by block) // 8 + sum(t) over (partition by block) // 8) // 16 as dc from n),
      s as (select block, unnest([{'k': 0, 'mode': 'dc', 'sad': sum(abs(v - dc))}, {'k': 1, 'mode': 'horizontal', 'sad': sum(abs(v - l))}, {'k': 2, 'mode': 'vertical', 'sad': sum(abs(v - t))}, {'k': 3, 'mode': 'planar', 'sad': sum(abs(v - (t + l) // 2))},
        {'k': 4, 'mode': 'diagonal', 'sad': sum(abs(v - least(greatest(t + l - c, 0), 255)))}]) as o from d group by block)
      select block, o.mode as mode, cast(o.sad as bigint) as sad from s qualify row_number() over (partition by block order by o.sad, o.k) = 1""",
    "transform_choice": f"""with e as (select block, p, y, x, v - 128 as v, abs(v - lag(v) over r) as a, abs(lead(v) over r - v) as b, abs(v - lag(v) over c) as d, abs(lead(v) over c - v) as e from blocks window r as (partition by block, y order by x), c as (partition by block, x order by y)),
      g as (select block, round(greatest(sum(v * v) / 64.0 - (sum(v) / 64.0) * (sum(v) / 64.0), 0), 6) as variance, round(sum((coalesce(a, 0) + coalesce(b, 0) + coalesce(d, 0) + coalesce(e, 0)) / ((a is not null)::int + (b is not null)::int + (d is not null)::int + (e is not null)::int)), 6) as laplacian from e group by block),
      q as (select block, round(max(u), 6) as quarter from (select block, greatest(sum(v * v) / 16.0 - (sum(v) / 16.0) * (sum(v) / 16.0), 0) as u from e group by block, y // 4, x // 4) group by block),
      w as (select block, count_if(w <> 0) as nonzero, 63 - coalesce(max(place) filter (w <> 0), -1) as tail from (select *, {PLACE} as place from ({WHOLE.replace("from blocks", "from (select block, y, x, v - 128 as v from blocks)")})) group by block)
      select block, variance, laplacian, quarter, nonzero, tail, case when variance >= 400 or laplacian >= 5000 or quarter * 64 >= 5000 then 'four4x4' else 'single8x8' end as grouping, case when tail >= 48 then 'run_first' when nonzero <= 8 then 'low_first' else 'zigzag' end as scan from g join q using (block) join w using (block)""",
    "scan_orders": f"""select block, sha256(string_agg(cast(w as varchar), ' ' order by {PLACE})) as zigzag, sha256(string_agg(cast(w as varchar), ' ' order by ky + kx, p)) as low_first, sha256(string_agg(cast(w as varchar), ' ' order by w = 0, {PLACE})) as run_first, true as restored from ({WHOLE}) group by block""",
    "residual_tokens": f"""with l as (select block, {PLACE} as place, (abs(w) + 8) // 16 * cast(sign(w) as bigint) as level from ({WHOLE})), a as (select * from l where place > 0),
      r as (select block, place, place - lag(place, 1, 0) over (partition by block order by place) - 1 as zeros, level from a where level <> 0), t as (select block, 64 as place, 63 - coalesce(max(place) filter (level <> 0), 0) as zeros, null as level from a group by block),
      s as (select block, place, repeat('62 ', (zeros // 62)::int) || case when zeros % 62 > 0 then (zeros % 62) || ' ' else '' end || case when level is null then '317' when level > 0 then (2 * level + 62) || ' ' else (-2 * level - 1 + 62) || ' ' end as said from (select * from r union all select * from t)),
      j as (select block, string_agg(said, '' order by place) as symbols from s group by block) select block, len(string_split(symbols, ' ')) as n, symbols, true as restored from j""",
    "coefficient_bytes": f"""select blocks, cast(sum(plain) as bigint) as plain, cast(sum(compact) as bigint) as compact, cast(sum(plain) - sum(compact) as bigint) as saved, round(100.0 * (sum(plain) - sum(compact)) / sum(plain), 6) as percent from (
      select block // 64 as blocks, (sum(case when w = 0 then 2 else 4 + length(bin(abs(w))) end) + 7) // 8 + 10 as plain, 18 + 2 * count_if(w <> 0) as compact from ({WHOLE}) group by block) group by blocks""",
    "colour_planes": f"""with t as (select trio, p, p // 8 as y, p % 8 as x, cast(a as double) as r, cast(b as double) as g, cast(c as double) as b, cast(0.2126 as double) * a + cast(0.7152 as double) * b + cast(0.0722 as double) * c as l from ({TRIO})),
      f as (select *, (b - l) / cast(1.8556 as double) as cb, (r - l) / cast(1.5748 as double) as cr from t),
      q as (select trio, y // 2 * 4 + x // 2 as q, {", ".join(BYTE.format(f"avg({BYTE.format(f'{c} * {k} + 128')})") + f" as {n}" for n, c, k in (("u", "cb", "1.0::double"), ("v", "cr", "1.0::double"), ("lu", "cb", "(224.0::double / 255)"), ("lv", "cr", "(224.0::double / 255)")))} from f group by all),
      m as (select trio, sum(u * (q + 1)) as u, sum(v * (q + 1)) as v, sum(lu * (q + 1)) as lu, sum(lv * (q + 1)) as lv from q group by trio),
      k as (select f.trio, p, {BYTE.format("l")} as y, {BYTE.format("l * (219.0::double / 255) + 16")} as ly, q.u - 128 as u, q.v - 128 as v from f join q on q.trio = f.trio and q.q = f.y // 2 * 4 + f.x // 2),
      n as (select trio, sum(y * (p + 1)) as y, sum(ly * (p + 1)) as ly, sum({BYTE.format("y + 1.5748::double * v")} * (p + 1)) as red, sum({BYTE.format("y - 0.1873::double * u - 0.4681::double * v")} * (p + 1)) as green, sum({BYTE.format("y + 1.8556::double * u")} * (p + 1)) as blue from k group by trio)
      select trio, {", ".join(f"cast({c} as bigint) as {c}" for c in ("y", "u", "v", "ly", "lu", "lv", "red", "green", "blue"))} from m join n using (trio)""",
}

CHANGE = "select '{0}' as table_name, cast({1} as varchar) as id, license_id, '{2}' as field, {3} as value from {4}"
STEPS = f"""select block // 100 as frame, least(greatest(28 + frame_delta, 24), 32) as qp from ({SQL["adaptive_deltas"].replace("with v as", "with vv as").replace("from v)", "from vv)").replace("from v, m", "from vv, m")})"""
FRAME_STEPS = f"""select frame, count_if(qp > 28) as up, count_if(qp < 28) as down, count_if(qp = 28) as unchanged, min(qp) as low, max(qp) as high, round(avg(qp), 6) as mean, cast(least(greatest(floor(avg(qp) + 0.5), 24), 32) as bigint) as effective from ({STEPS}) group by frame"""
CHOICES = f"""select clip, line, part, bytes, qp, cast(case when searched < still then 1 else 0 end as bigint) as chosen, 2 + sx + sy as side_bytes from (select *, bytes // 16 + lam * (sx + sy) // 256 as searched, bytes // 16 + part % 7 + lam * 2 // 256 as still from (
      select *, 217 * (case when e >= 0 then 256 << e else 256 >> -e end) // 256 as lam, case when zx < 128 then 1 when zx < 16384 then 2 else 3 end as sx, case when zy < 128 then 1 when zy < 16384 then 2 else 3 end as sy from (
        select *, least(greatest(cast((qp - 12) // 3 as integer), -8), 16) as e, case when part % 200 - 100 >= 0 then 2 * (part % 200 - 100) else -2 * (part % 200 - 100) - 1 end as zx, case when clip % 90 - 45 >= 0 then 2 * (clip % 90 - 45) else -2 * (clip % 90 - 45) - 1 end as zy from sweep_rows where {VALID})))"""
FRAMES = "select l_orderkey as clip, l_linenumber as frame, cast(floor(l_extendedprice) as bigint) as bytes, l_partkey as k from lineitem"
DECODED = f"select clip, frame + unnest(case when k % 11 = 0 then [] when k % 13 = 0 then [0, 0] when k % 17 = 0 then [100] else [0] end) as frame, bytes from ({FRAMES})"
PICTURES = "select p_partkey as id, p_partkey * 7 % 1000 + 16 as width, p_partkey * 11 % 600 + 16 as height from part"
REGIONS = f"select id, (width + 63) // 64 as cols, (height + 63) // 64 as rows, width, height from ({PICTURES})"
STATE_KEYS = {"licenses": "license_id", "license_keys": "key_id", "installations": "installation_id", "verification_requests": "request_id", "audit_events": "event_id"}
SQL |= {
    "ordered_keys": f"select key_id, license_id, created, record_state from license_keys order by {RANK}, created desc, key_id",
    "feature_gate": "select license_id, record_state = 'active' and license_id in (select license_id from license_features where feature_name = 'editor') as allowed from licenses",
    "feature_slugs": "select feature_name, case feature_name when 'editor' then 'Editor workspace' when 'import' then 'Import' when 'export' then 'Export' when 'batch' then 'Batch processing' else 'Basic playback' end as display, feature_name in ('basic', 'editor', 'import', 'export', 'batch') as known, count(*) as n from license_features group by feature_name",
    "state_defaults": "select o_orderkey as key_id, o_orderkey % 2 = 1 as active, case o_orderkey % 4 when 1 then 'archived' when 3 then 'deleted' else 'active' end as record_state, case o_orderkey % 4 when 1 then 'Archived' when 3 then 'Deleted' else 'Active' end as display from orders",
    "unknown_licenses": "select request_id, license_id from playback_requests where license_id is not null and license_id not in (select license_id from licenses where record_state <> 'deleted')",
    "license_issue": " union all ".join(
        [
            CHANGE.format("licenses", "license_id", "created", "'1706000000'", "licenses where license_id % 10 = 0"),
            CHANGE.format("license_keys", "'key-' || license_id", "active", "'true'", "licenses where license_id % 10 = 0"),
            CHANGE.format("license_features", "license_id", "feature_name", "f", "(select license_id, unnest(case when license_id % 3 = 0 then ['basic'] else ['editor', 'export'] end) as f from licenses where license_id % 10 = 0)"),
            CHANGE.format("audit_events", "'key-' || license_id", "license_issued", """'{"email":"' || owner || '","features":' || case when license_id % 3 = 0 then '["basic"]' else '["editor","export"]' end || '}'""", "licenses where license_id % 10 = 0"),
        ]
    ),
    "cascade_rows": " union all ".join(CHANGE.format(t, k, "record_state", "'deleted'", f"{t} where license_id % 7 = 0 and record_state <> 'deleted'") for t, k in STATE_KEYS.items()),
    "key_state_audit": CHANGE.format("license_keys", "key_id", "record_state", "'archived'", "license_keys where key_id % 6 = 0") + " union all " + CHANGE.format("audit_events", "key_id", "admin_key_state_updated", """'{"state":"archived"}'""", "license_keys where key_id % 6 = 0"),
    "request_approve": CHANGE.format("verification_requests", "request_id", "approved", "'1706000000'", "verification_requests where request_id % 4 = 0 and approved is null") + " union all " + CHANGE.format("audit_events", "request_id", "admin_request_approved", """'{"request_id":' || request_id || '}'""", "verification_requests where request_id % 4 = 0 and approved is null"),
    "schema_migrate": "select c_custkey as license_id, c_name as owner, 'active' as record_state, cast(null as bigint) as state_changed from customer",
    "label_first_min": f"select clip // 500 as clips, bytes, clip, line, part from sweep_rows where {VALID} and contains(cost_model, 'rdo') qualify row_number() over (partition by clip // 500 order by bytes, clip, line, part) = 1",
    "clip_candidates": f"""with c as (select * from sweep_rows where {VALID} qualify row_number() over (partition by clip order by bytes, ssim desc, line, part) = 1), g as (select * from sweep_rows where {VALID} qualify row_number() over (partition by clip order by ssim desc, bytes, line, part) = 1)
      select clip, c.bytes as least_bytes, c.line as least_line, g.ssim as best_ssim, g.bytes as best_bytes, g.line as best_line from c join g using (clip)""",
    "syntax_pairs": f"""select a.base, v1, v2, v2 - v1 as delta from (select clip || '-' || inter_partition as base, min(bytes) as v1 from sweep_rows where {VALID} and part % 2 = 0 group by 1) a join (select clip || '-' || inter_partition as base, min(bytes) as v2 from sweep_rows where {VALID} and part % 2 = 1 group by 1) b using (base)""",
    "grid_with_extras": f"{SQL['sweep_grid']} union select qp, inter_syntax, entropy_model, cost_model, inter_partition from sweep_rows where line = 7",
    "b_modes": f"""with r as (select *, line % 3 as mode from sweep_rows where {VALID} qualify row_number() over (partition by clip, line % 3 order by line desc, part desc, bytes desc) = 1),
      w as (select clip, max(bytes) filter (mode = 0) as a, max(bytes) filter (mode = 1) as b, max(bytes) filter (mode = 2) as c, sum(part % 100) as wb, sum(part % 10) as hb from r group by clip having count(*) = 3)
      select clip // 500 as clips, count(*) as n, count_if(b < a) as half_lower, count_if(c < a) as weighted_lower, cast(sum(wb) as bigint) as weighted_blocks, cast(sum(hb) as bigint) as half_blocks from w group by 1""",
    "rate_report": "select clip // 1000 as clips, min(qp) as min_qp, max(qp) as max_qp, round(avg(qp), 6) as avg_qp, round(sum(bytes) * 240.0::double / count(*), 6) as rate, round((sum(bytes) * 240.0::double / count(*) - 9000000) / 9000000.0::double * 100, 6) as error_percent from sweep_rows group by 1",
    "quality_steps": FRAME_STEPS,
    "quality_steps_merged": f"select frame % 3 as plane, cast(sum(up) as bigint) as up, cast(sum(down) as bigint) as down, cast(sum(unchanged) as bigint) as unchanged, min(low) as low, max(high) as high, round(sum(qsum) / sum(up + down + unchanged), 6) as mean from (select f.*, q.qsum from ({FRAME_STEPS}) f join (select frame, cast(sum(qp) as double) as qsum from ({STEPS}) group by frame) q using (frame)) group by 1",
    "still_or_searched": CHOICES,
    "decision_counters": f"select qp, 2 * count(*) as compared, cast(sum(side_bytes) as bigint) as side_bytes, count_if(chosen = 0) as still_wins, count_if(chosen = 1) as searched_wins from ({CHOICES}) group by qp",
    "vector_statistics": f"select frame, cast(sum((dx = 0)::int + (dy = 0)::int) as bigint) as zero, cast(sum((dx <> 0)::int + (dy <> 0)::int) as bigint) as others, cast(sum(abs(dx) + abs(dy)) as bigint) as sizes, round(sum(abs(dx) + abs(dy)) / (2 * count(*)), 6) as mean from ({SQL['mv_predict_delta']}) group by frame",
    "motion_telemetry": f"select frame, count_if(mvx <> 0 or mvy <> 0) as moving, cast(sum(abs(mvx) + abs(mvy)) as bigint) as length, count(*) as blocks from ({SQL['sad_search']}) group by frame",
    "activity_scores": f"""select frame, "by", bx, variance_sum // 256 + gradient // 16 as activity, 2 * gradient + variance_sum // 512 as edges, 2 * gradient + gradient // 4 as screen from ({SQL['block_activity']})""",
    "side_bytes": """select cast(u as bigint) as units, inter_syntax, count(*) as n, cast(sum(case inter_syntax when 'compact' then 9 else 10 end + case when ok then 2 else 0 end) as bigint) as header, cast(sum(case u when 1 then 0 when 2 then 1 else 4 end) as bigint) as partition, cast(sum(case u when 1 then 0 when 2 then 2 else 4 end) as bigint) as transform, cast(sum(case when ok then u - 1 else 0 end) as bigint) as steps
      from (select *, case part % 4 when 0 then 1 when 3 then 4 else 2 end as u from sweep_rows) group by u, inter_syntax""",
    "report_sentences": f"""select qp, case when c < s then 'context needs ' || (s - c) || ' bytes less than static (' || c || ')' when c > s then 'context needs ' || (c - s) || ' bytes more than static (' || c || ')' else 'context and static tie at ' || s end as summary from (
      select qp, cast(sum(case when entropy_model = 'static' then bytes else 0 end) as bigint) as s, cast(sum(case when entropy_model = 'context' then bytes else 0 end) as bigint) as c from sweep_rows where {VALID} group by qp)""",
    "report_markdown": f"select clip, line, part, '| ' || clip || ' | ' || line || ' | ' || part || ' | ' || qp || ' | ' || bytes || ' |' as text from sweep_rows where {VALID} order by bytes desc, clip, line, part limit 50",
    "encoder_listed": "select p_partkey, regexp_matches(lower(p_name), '(^|\\s)ring(\\s|$)') as listed from part",
    "path_routes": "select page_id, case page_id % 6 when 0 then 'play' when 1 then 'play' when 2 then 'import' when 5 then 'audio' else 'refused' end as route from pages",
    "picture_limits": """select id, case when k = 0 then case when w = 0 or h = 0 then 'empty' when w > 8192 or h > 8192 then 'side' when w * h > 33554432 then 'pixels' else 'ok' end when k = 1 then case when r = 0 then 'rate' when c not in (1, 2) then 'channels' else 'ok' end else 'ok' end as reason
      from (select p_partkey as id, p_partkey % 3 as k, p_partkey * 37 % 9000 as w, p_partkey * 53 % 8192 as h, p_partkey % 5 * 8000 as r, p_partkey % 4 as c from part)""",
    "silent_tracks": "select track_id, codec from tracks where track_id not in (select track_id from packets where track_id <> 2)",
    "notices_unseen": "select license_id, email_id from email_outbox except select license_id, email_id from (select * from email_outbox where email_id % 3 <> 0 qualify row_number() over (partition by license_id order by created desc, email_id desc) <= 2)",
    "frame_pairs": f"""with s as (select clip, frame, count(*) as n from ({FRAMES}) group by all), d as (select clip, frame, count(*) as n, min(bytes) as bytes from ({DECODED}) group by all)
      select coalesce(s.clip, d.clip) as clip, coalesce(s.frame, d.frame) as frame, case when s.n is null then 'out_of_range' when d.n is null then 'missing' when d.n > 1 or s.n > 1 then 'duplicate' else 'ok' end as fault, d.bytes from s full join d on s.clip = d.clip and s.frame = d.frame""",
    "display_order": f"select clip, frame, row_number() over w - 1 as place, cast(coalesce(sum(bytes) over (w rows between unbounded preceding and 1 preceding), 0) as bigint) as file_offset, count(*) over (partition by clip) > 5 as exceeded from (select clip, frame, min(bytes) as bytes from ({DECODED}) group by all) window w as (partition by clip order by frame)",
    "ticks_of_ms": "select track_id, sequence, ticks, ticks * 1000 // timescale as ms from (select track_id, sequence, timescale, us // 1000 * timescale // 1000 as ticks from packets join tracks using (track_id))",
    "skip_budget": "select stretch, max(run) as longest, max(run) > 8 as exceeded from (select stretch, isle, count_if(not wanted) as run from (select *, sum(wanted::int) over (partition by stretch order by sequence) as isle from (select sequence // 1000 as stretch, sequence, track_id = 1 as wanted from packets)) group by all) group by stretch",
    "player_states": """with recursive e as (select user_id, row_number() over (partition by user_id order by event_id) as k, case event_type when 'signup' then 'play' when 'purchase' then 'pause' when 'error' then 'stop' when 'click' then 'end' else 'step' end as c from events),
      f as (select user_id, cast(0 as bigint) as k, 'stopped' as state from e group by user_id union all select f.user_id, e.k, case when c = 'stop' then 'stopped' when c = 'play' and state <> 'ended' then 'playing' when c = 'pause' and state = 'playing' then 'paused' when c = 'end' and state = 'playing' then 'ended' else state end from f join e on e.user_id = f.user_id and e.k = f.k + 1)
      select user_id, k as commands, state from f qualify row_number() over (partition by user_id order by k desc) = 1""",
    "interleaved": "select pair, count(*) as n, sha256(string_agg(cast(s as varchar), ' ' order by p, c)) as digest, true as restored from (select stream // 2 as pair, stream % 2 as c, p, s from audio) group by pair having count(distinct c) = 2",
    "superchunk_grid": f"select id, cols, rows, cols * rows as regions, (cols - 1) * 64 as x0, (rows - 1) * 64 as y0, (cols - 1) * 32 as cx0, (rows - 1) * 32 as cy0, (width + 1) // 2 as cx1, (height + 1) // 2 as cy1 from ({REGIONS})",
    "superchunk_regions": f"select id, cols * rows as regions, width * height as samples, (width - (cols - 1) * 64) * (height - (rows - 1) * 64) as least from ({REGIONS})",
}
FILES = "select sequence // 500 as file, row_number() over (partition by sequence // 500 order by sequence) - 1 as n, track_id, flags, pts, size from packets"
SQL |= {f"{c}_round_trip": "select stream, count(*) as n, true as ok from audio group by stream" for c in ("varint", "rans", "contexts", "bits", "lpc", "runs")}
SQL |= {
    "container_packets": f"select file, n as sequence, track_id, flags, pts, size from ({FILES})",
    "container_entries": f"select file, 'index' as kind, count(*) as entries, cast(sum(n) as bigint) as numbers, max(pts) as max_pts, cast(0 as bigint) as cues from ({FILES}) group by file union all select file, 'cue', count(*), cast(sum(n) as bigint), max(pts), count(distinct n // 32) from ({FILES}) group by file",
    "preset_metadata": """select *, '{"pattern":"' || pattern || '","width":' || width || ',"height":' || height || ',"fps":30,"frames":' || frames || ',"format":"yuv420p","bytes":' || bytes || '}' as document from (
      select name, pattern, w as width, w as height, 30 as fps, f as frames, 'yuv420p' as format, w * w * 3 // 2 * f as bytes from (values ('flat', 'flat', 64, 16), ('gradient', 'ramp', 64, 16), ('moving_square', 'square', 128, 24), ('scrolling_bars', 'bars', 128, 24), ('checker', 'checker', 64, 16), ('noise', 'noise', 64, 16), ('scene_cut', 'cut', 128, 24)) t(name, pattern, w, f))""",
}
TAP = "left join px {0} on {0}.frame = e.frame - 1 and {0}.x = e.ix + {1} and {0}.y = e.iy + {2}"
SQL["half_places"] = SAD + f""", o as (select * from (values (0, 0, 0), (1, -2, -2), (2, 0, -2), (3, 2, -2), (4, -2, 0), (5, 2, 0), (6, -2, 2), (7, 0, 2), (8, 2, 2)) t(k, ox, oy)),
  e as (select c.frame, b."by", b.bx, k, b.mvx * 4 + ox as qx, b.mvy * 4 + oy as qy, c.v, cast(floor((c.x * 4 + b.mvx * 4 + ox) / 4) as bigint) as ix, cast(floor((c.y * 4 + b.mvy * 4 + oy) / 4) as bigint) as iy, (ox + 4) % 4 as fx, (oy + 4) % 4 as fy from px c join best b on b.frame = c.frame and b."by" = c.y // 16 and b.bx = c.x // 16, o),
  z as (select e.frame, e."by", e.bx, k, qx, qy, sum(abs(e.v - ((coalesce(a.v, 128) * (4 - fx) * (4 - fy) + coalesce(b.v, 128) * fx * (4 - fy) + coalesce(c.v, 128) * (4 - fx) * fy + coalesce(d.v, 128) * fx * fy + 8) >> 4))) as sad
    from e {TAP.format("a", 0, 0)} {TAP.format("b", 1, 0)} {TAP.format("c", 0, 1)} {TAP.format("d", 1, 1)} group by all)
  select frame, "by", bx, qx, qy, cast(sad as bigint) as sad from z qualify row_number() over (partition by frame, "by", bx order by sad, k) = 1"""
SQL["sweep_grid_quick"] = f"select * from ({SQL['sweep_grid']}) where qp <= 22"
ORACLE_SQL = {k: oracle(v) for k, v in SQL.items()}
