"""DuckDB SQL for the text operators that SQL can express."""

WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
TOKENS = r"coalesce(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), [])"
LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Every diagonal of every document and item, without seeds.
DECONTAMINATE = f"""with d as (select doc_id, {TOKENS} as w from documents where doc_id is not null), b as (select item_id, {TOKENS} as w from benchmark where item_id is not null),
  dw as (select doc_id, unnest(w) as t, generate_subscripts(w, 1) as i from d), bw as (select item_id, len(w) as n, unnest(w) as t, generate_subscripts(w, 1) as k from b),
  cells as (select doc_id, item_id, n, least(16, n) as wide, i - k as diagonal, k from dw join bw using (t)),
  live as (select doc_id, item_id, diagonal from cells group by doc_id, item_id, diagonal, n, wide having count(*) >= case when n < 9 then n else 0.75 * wide end),
  sums as (select doc_id, item_id, n, wide, count(*) over (partition by doc_id, item_id, diagonal order by k range between current row and 15 following) as matched from cells semi join live using (doc_id, item_id, diagonal)),
  best as (select doc_id, item_id, n, wide, max(matched) as matched from sums group by doc_id, item_id, n, wide)
  select doc_id, item_id, cast(n as integer) as n_item, cast(wide as integer) as n_window, cast(matched as integer) as n_matched, matched / wide as share from best where matched / wide >= case when n < 9 then 1.0 else 0.75 end"""

SUBSTRING = rf"""with d as (select doc_id, coalesce({WORDS.format("text")}, []) as w from documents),
  g as (select doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) as h from (select doc_id, w, unnest(range(1, len(w) - 48)) as i from d)),
  first as (select h, min(doc_id) as m from g group by h),
  gone as (select distinct doc_id, unnest(range(i, i + 50)) as p from g join first using (h) where doc_id > m),
  stay as (select d.doc_id, p, w[p] as x from (select doc_id, w, unnest(range(1, len(w) + 1)) as p from d) d anti join gone on d.doc_id = gone.doc_id and d.p = gone.p),
  kept as (select doc_id, count(*) as n, string_agg(x, ' ' order by p) as t from stay group by doc_id)
  select d.doc_id, len(w) as n_words, len(w) - coalesce(n, 0) as n_removed, sha256(coalesce(t, '')) as kept_sha256 from d left join kept using (doc_id)"""

MINHASH = f"""with recursive d as (select doc_id, coalesce({WORDS.format(LOWER)}, []) as w from documents),
  s as (select distinct doc_id, case when len(w) < 5 then array_to_string(w, ' ') else array_to_string(w[i:i + 4], ' ') end as g from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) as i from d where len(w) > 0)),
  n as (select doc_id, count(*) as n from s group by doc_id),
  common as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
  linked as (select a, b from common join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 85 * (x.n + y.n - k)),
  ways as (select a, b from linked union all select b, a from linked),
  reach as (select distinct a as id, a as top from ways union select ways.b, reach.top from reach join ways on ways.a = reach.id),
  c as (select id, min(top) as component_id from reach group by id)
  select d.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(c.component_id, d.doc_id) as component_id, coalesce(c.component_id, d.doc_id) = d.doc_id as kept from d left join n on n.doc_id = d.doc_id left join c on c.id = d.doc_id"""

EMBEDDING = """with recursive v as (select vec_id, cast(embedding as double[]) as e from embeddings),
  linked as (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id where list_cosine_similarity(a.e, b.e) >= 0.9),
  reach as (select distinct a as id, a as top from linked union select linked.b, reach.top from reach join linked on linked.a = reach.id),
  c as (select id, min(top) as component_id from reach group by id), n as (select a, count(*) as n from linked group by a)
  select v.vec_id, coalesce(n.n, 0) as n_links, coalesce(c.component_id, v.vec_id) as component_id, coalesce(c.component_id, v.vec_id) = v.vec_id as kept from v left join n on n.a = v.vec_id left join c on c.id = v.vec_id"""

ORACLE_SQL = {"op1_decontaminate": DECONTAMINATE, "op5_substring": SUBSTRING, "op7_minhash": MINHASH, "op9_embedding": EMBEDDING}
