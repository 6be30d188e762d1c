"""DuckDB SQL that must give the same rows as the queries of the operators that SQL can express."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_QUALITY = rf"""
with base as (
  select row_number() over () as rid, doc_id, source, coalesce(text, '') as t, {_WORDS} as w from documents),
lines as (
  select rid, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from base),
tri as (
  select rid, w[i:i + 2] as g, i from (select rid, w, unnest(generate_series(1, len(w) - 2)) as i from base)),
twice as (
  select rid, i from (select rid, i, count(*) over (partition by rid, g) as n from tri) where n > 1),
covered as (
  select rid, count(distinct p) as n from (select rid, unnest([i, i + 1, i + 2]) as p from twice) group by rid),
counts as (
  select base.rid, doc_id, source, cast(len(w) as bigint) as n_words,
    cast(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as bigint) as word_chars,
    cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
    cast(len(l) - len(list_distinct(l)) as bigint) as n_dup_lines,
    cast(coalesce(covered.n, 0) as bigint) as n_repeat_words,
    len(string_split(t, chr(10))) as n_lines,
    coalesce(list_sum(list_transform(w, lambda x: case when upper(x) = x and lower(x) <> x then length(x) else 0 end)), 0) as n_upper
  from base join lines using (rid) left join covered using (rid)),
judged as (
  select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
    cast(n_words < 50 or 100 * n_repeat_words > 50 * n_words as int) + cast(n_symbols > 0.1 * n_words as int)
    + cast(n_dup_lines > 0.3 * n_lines as int) + cast(n_upper > 0.5 * word_chars as int) as rules_failed
  from counts),
hosts as (
  select source, count(*) as n, sum(cast(rules_failed > 0 as bigint)) as failed from judged group by source),
moments as (
  select sum(n) as docs, count(*) as hosts, sum(failed) / sum(n) as m, sum(n * (failed / n) * (failed / n)) / sum(n) as square
  from hosts),
spread as (select m, square - m * m - m * (1 - m) * hosts / docs as v from moments),
prior as (
  select m, case when v > 0 then greatest(least(m * (1 - m) / v - 1, 1000.0), 1.0) else 1000.0 end as weight from spread),
rates as (
  select source, (failed + m * weight) / (n + weight) as rate from hosts, prior where source is not null)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  rules_failed = 0 and coalesce(rate, m) <= 0.5 as kept, rules_failed, round(coalesce(rate, m), 9) as host_rate
from judged cross join prior left join rates on rates.source = judged.source
"""

_MIX = rf"""
with recursive sized as (
  select doc_id, source, cast(len({_WORDS}) as bigint) as size, coalesce(md5(cast(doc_id as varchar)), md5('null')) as key
  from documents),
sources as (
  select source, cast(sum(size) as bigint) as source_size from sized group by source),
weighed as (
  select source, source_size, 2.0::double * source_size as most, (sum(source_size) over ())::double as total,
    list_value(5.0::double, 2.0, 1.0)[((row_number() over (order by source is null, source collate "binary") - 1) % 3) + 1] as weight
  from sources),
rounds as (
  select 0 as k, 0.0::double as level
  union all
  select k + 1, (select (1.5 * max(total) - coalesce(sum(case when weight * level > most then most end), 0))
    / sum(case when weight * level <= most then weight end) from weighed)
  from rounds where k < (select count(*) from sources)),
goal as (
  select source, source_size, least(weight * (select max(level) from rounds), most) as target from weighed),
whole as (
  select *, case when source_size > 0 then cast(floor(round(target) / source_size) as bigint) else 0 end as epochs from goal),
placed as (
  select sized.doc_id, sized.source, size, source_size, target, epochs,
    cast(round(target) - epochs * source_size as bigint) as rest,
    sum(size) over (partition by sized.source, key, size, sized.doc_id) as tied,
    sum(size) over (partition by sized.source order by key, size, sized.doc_id nulls first
      range between unbounded preceding and current row) as upto
  from sized join whole on sized.source is not distinct from whole.source)
select doc_id, size, source_size, target,
  cast(epochs * size + case when upto <= rest then size when upto - tied >= rest or size = 0 then 0
    else floor((rest - (upto - tied)) / (tied / size)) end as bigint) as taken
from placed
"""

_NEGATIVES = """
with vectors as (
  select distinct vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    [floor(256 * x::double) for x in embedding] as v
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, cast(list_inner_product(a.v, b.v) as bigint) as score
  from vectors a join vectors b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0),
positives as (
  select anchor_id, vec_id as positive_id, score as positive_score from scored where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5),
ranked as (
  select anchor_id, positive_id, cast(row_number() over (partition by anchor_id, positive_id order by score desc, vec_id) as int) as rank,
    vec_id as negative_id, positive_score, score as negative_score
  from positives join scored using (anchor_id)
  where not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score)
select * from ranked where rank <= 10
"""

ORACLES = {
    "op13_hard_negatives": _NEGATIVES,
    "op7_source_mix": _MIX,
    "op9_quality_rules": _QUALITY,
}
