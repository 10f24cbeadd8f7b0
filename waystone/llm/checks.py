"""DuckDB SQL that states the rows of queries in another way than the operators compute them."""

from __future__ import annotations

#: Words meet on equal rests after one deletion; crc32 is computed byte by byte from its table.
SPELLING = """
with recursive bits as (
  select i as start, i as v, 0 as k from range(256) t(i)
  union all
  select start, case when v % 2 = 1 then xor(v >> 1, 3988292384) else v >> 1 end, k + 1 from bits where k < 8
), crc as (select list(v order by start) as entry from bits where k = 8),
runs as (
  select coalesce(cast(doc_id as varchar), '') as mark,
         unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\\x{00C0}-\\x{00FF}]+')) as run
  from documents
), lowered as (
  select mark, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run, count(*) as times
  from runs group by all
), coded as (
  select mark, run, times, hex(encode(mark || ':' || run)) as code from lowered
), hashed as (
  select run, times, xor(list_reduce(
      list_prepend(4294967295, list_transform(range(1, length(code), 2), lambda i:
        cast(16 * (instr('0123456789ABCDEF', code[i]) - 1) + instr('0123456789ABCDEF', code[i + 1]) - 1 as bigint))),
      lambda acc, b: xor(acc >> 8, entry[(xor(acc, b) & 255) + 1])), 4294967295) as h
  from coded, crc
), cut as (
  select case when h % 97 = 0
    then substr(run, 1, cast(h % length(run) as bigint)) || substr(run, cast(h % length(run) as bigint) + 2)
    else run end as word, times
  from hashed
), words as (
  select word, cast(sum(times) as bigint) as n from cut where length(word) >= 5 group by word having sum(times) >= 3
), rests as (
  select word, n, i, substr(word, 1, i) || substr(word, i + 2) as rest
  from (select word, n, unnest(range(length(word))) as i from words)
), pairs as (
  select a.word as a, b.word as b, b.n as bn
  from rests a join rests b on a.rest = b.rest and a.i = b.i and a.word <> b.word
  union select r.word, w.word, w.n from rests r join words w on r.rest = w.word
  union select w.word, r.word, r.n from rests r join words w on r.rest = w.word
), near as (
  select a as word, count(*) as n_near, max(bn) as best_n, arg_min(b, {'k': -bn, 'w': b}) as best
  from pairs group by a
), judged as (
  select w.word, w.n, coalesce(n_near, 0) as n_near,
         case when best_n >= 2 * w.n then best end as form, case when best_n >= 2 * w.n then best_n end as form_n
  from words w left join near using (word)
), chain as (
  select word, word as root, form as next from judged
  union all
  select c.word, c.next, j.form from chain c join judged j on c.next = j.word
)
select j.word, j.form, c.root, j.n, cast(j.n_near as bigint) as n_near, j.form_n
from judged j join chain c on c.word = j.word and c.next is null
"""

WARC = """
with own as (
  select page_id, coalesce(html, '') as payload from pages
), coded as (
  select page_id, payload, cast(octet_length(encode(payload)) as bigint) as payload_bytes,
         min(page_id) over (partition by payload) as first_id, upper(sha1(payload)) as code
  from own
), digits as (
  select *, list_transform(range(40), lambda i: instr('0123456789ABCDEF', code[i + 1]) - 1) as d from coded
), bits as (
  select *, list_transform(range(8), lambda g: cast(
      65536 * d[5 * g + 1] + 4096 * d[5 * g + 2] + 256 * d[5 * g + 3] + 16 * d[5 * g + 4] + d[5 * g + 5] as bigint)) as b
  from digits
)
select page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i:
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((b[i // 4 + 1] >> (15 - 5 * (i % 4))) & 31) + 1]), '') as payload_digest,
       case when page_id = first_id then 'response' else 'revisit' end as record_type,
       case when page_id <> first_id then first_id end as refers_to
from bits
"""

TOP_K = """
with scaled as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as c, len(embedding) as width
  from embeddings
  where embedding is not null and vec_id is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select q.vec_id as query_id, v.vec_id,
         cast(list_sum(list_transform(list_zip(q.c, v.c), lambda p: p[1] * p[2])) as bigint) as score
  from scaled q join scaled v on q.width = v.width and q.vec_id <> v.vec_id
  where q.vec_id % 50 = 0
), ranked as (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored
)
select cast(query_id as bigint) as query_id, cast(rank as integer) as rank, cast(vec_id as bigint) as vec_id, score
from ranked where rank <= 5
"""

LINES = """
with lines as (
  select doc_id, row, cast(generate_subscripts(parts, 1) as bigint) as pos, unnest(parts) as line
  from (select doc_id, row_number() over () as row, string_split(coalesce(text, ''), chr(10)) as parts from documents)
), keyed as (
  select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from lines
), firsts as (
  select key, min(doc_id) as first from keyed where length(key) >= 10 group by key
)
select any_value(k.doc_id) as doc_id, count(*) as n_lines,
       count(*) filter (k.doc_id is distinct from coalesce(f.first, k.doc_id)) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos)
         filter (k.doc_id is not distinct from coalesce(f.first, k.doc_id)), '')) as kept_sha256
from keyed k left join firsts f on f.key = k.key group by row
"""


def centroid_sql(k: int = 40, rounds: int = 5, width: int = 64, scale: int = 256, seed: str = "2") -> str:
    """Rounds written out one after the other, with all distances computed from components."""
    parts = [
        f"""with points as materialized (
  select row_number() over () as row, vec_id, list_transform(embedding, lambda x: cast(floor({scale} * cast(x as double)) as bigint)) as v
  from embeddings
  where len(embedding) = {width}
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), c0 as materialized (
  select cast(row_number() over (order by sha256('{seed}:' || cast(vec_id as varchar)) nulls last, v) - 1 as integer) as cluster, v as c
  from points qualify cluster < {k}
)"""
    ]
    for r in range(rounds + 1):
        parts.append(f"""a{r} as materialized (
  select row, min(vec_id) as vec_id, min(v) as v, arg_min(cluster, {{'d': d, 'c': cluster}}) as cluster, min(d) as distance
  from (select p.row, p.vec_id, p.v, cluster,
               cast(list_sum(list_transform(range(1, {width + 1}), lambda j: (v[j] - c[j]) * (v[j] - c[j]))) as bigint) as d
        from points p cross join c{r})
  group by row
)""")
        if r == rounds:
            break
        parts.append(f"""c{r + 1} as materialized (
  select c{r}.cluster, coalesce(m.c, c{r}.c) as c
  from c{r} left join (
    select cluster, list(((s - ((s % n) + n) % n) // n) order by j) as c
    from (select cluster, j, cast(sum(x) as bigint) as s, count(*) as n
          from (select cluster, unnest(range({width})) as j, unnest(v) as x from a{r}) group by cluster, j)
    group by cluster) m on m.cluster = c{r}.cluster
)""")
    parts.append(f"""sums as (
  select cluster, cast(sum(distance) as bigint) as cluster_inertia from a{rounds} group by cluster
)
select a.vec_id, a.cluster, a.distance, s.cluster_inertia,
       cast((select sum(distance) from a{rounds}) as bigint) as inertia,
       sha256(array_to_string(c.c, ',')) as centroid_sha256
from a{rounds} a join sums s on s.cluster = a.cluster join c{rounds} c on c.cluster = a.cluster""")
    return parts[0] + ", " + ", ".join(parts[1:-1]) + ", " + parts[-1]
