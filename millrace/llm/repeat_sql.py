"""SQL for the search of periodic runs: six words in a row that come again make islands by distance."""

from __future__ import annotations

_CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)),
    lambda a, c: list_reduce(list_prepend(xor(a, c), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))))"""

PERIODIC_RUNS = rf"""with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws, {_CRC32} as h from documents),
    e as (select doc_id, ws, len(ws) as n, h % 10 = 0 and len(ws) > 0 as planted, h // 10 as g from d),
    f as (select *, case when n > 0 then g % n else 0 end as a from e),
    p as (select *, 1 + (n - a) // (3 + g % 8) as p from f),
    w as materialized (select doc_id, n, i, ws[1 + case when planted and i >= a then a + (i - a) % p else i end] as w from (select *, unnest(range(n)) as i from p)),
    k as materialized (select doc_id, n, i, w || ' ' || lead(w, 1) over o || ' ' || lead(w, 2) over o || ' ' || lead(w, 3) over o || ' ' || lead(w, 4) over o || ' ' || lead(w, 5) over o as six
        from w window o as (partition by doc_id order by i)),
    pairs as (select x.doc_id, x.i, y.i - x.i as q from k x join k y on x.doc_id = y.doc_id and x.six = y.six and y.i > x.i and 2 * (y.i - x.i) <= x.n),
    islands as (select doc_id, q, min(i) as s, count(*) + 5 + q as l from (select *, i - row_number() over (partition by doc_id, q order by i) as island from pairs) group by doc_id, q, island),
    runs as materialized (select doc_id, s, l, min(q) as q from islands where l >= greatest(12, 2 * q) group by 1, 2, 3),
    steps as (select doc_id, i, sum(step) as step from (select doc_id, s + q as i, 1 as step from runs union all select doc_id, s + l, -1 from runs) group by 1, 2),
    marked as (select doc_id, i, w, sum(coalesce(step, 0)) over (partition by doc_id order by i) as inside from w left join steps using (doc_id, i)),
    kept as (select doc_id, string_agg(w, ' ' order by i) filter (inside = 0) as kept from marked group by 1),
    listed as (select doc_id, count(*) as n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' order by s, q) as runs from runs group by 1),
    best as (select * from runs qualify row_number() over (partition by doc_id order by l desc, s, q) = 1)
    select doc_id, coalesce(n_runs, 0) as n_runs, s as "start", l as length, q as period, 1000 * l // q as exponent_milli, sha256(coalesce(runs, '')) as runs_sha256, sha256(coalesce(kept, '')) as collapsed_sha256
    from documents left join listed using (doc_id) left join best using (doc_id) left join kept using (doc_id)"""
