"""DuckDB SQL of the operators that SQL can express."""

from __future__ import annotations

from weftline.llm import licenses

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

JACCARD = rf"""with recursive w as (select doc_id, list_filter(string_split_regex({LOWER}, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
 s as (select distinct doc_id, sh from (select doc_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as sh from w)),
 n as (select doc_id, count(*) as n from s group by doc_id),
 p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.sh = b.sh and a.doc_id < b.doc_id group by 1, 2),
 l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)),
 e as (select a, b from l union select b, a from l),
 r(x, y) as (select doc_id, doc_id from documents union select r.x, e.b from r join e on e.a = r.y),
 m as (select x, min(y) as component_id from r group by x)
 select d.doc_id, coalesce(n.n, 0) as n_shingles, m.component_id from documents d left join n on n.doc_id = d.doc_id join m on m.x = d.doc_id"""


def license_sql() -> str:
    """The scan with the operator's own templates, as one statement: phrases as slices of the word list, notices as longest chains of grams."""
    rows = [(t, label, t < len(licenses.PHRASES), line) for t, (line, label) in enumerate([*licenses.PHRASES, *licenses.NOTICES])]
    values = ", ".join(f"({t}, '{label}', {str(phrase).lower()}, '{line}')" for t, label, phrase, line in rows)
    return rf"""with recursive t as (select t, label, phrase, string_split(line, ' ') as w from (values {values}) as v(t, label, phrase, line)),
 d as (select doc_id, list_filter(string_split_regex({LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from documents),
 pos as (select doc_id, w, unnest(range(1, len(w) + 1)) as i from d),
 base as (select doc_id, i - 1 as first, label from pos, t where phrase and pos.w[i] = t.w[1] and pos.w[i:i + len(t.w) - 1] = t.w),
 g as (select t, label, len(w) - 1 as grams, i as place, w[i] as a, w[i + 1] as b from (select t, label, w, unnest(range(1, len(w))) as i from t where not phrase)),
 h as (select doc_id, t, label, grams, i as spot, place from (select doc_id, i, w[i] as a, w[i + 1] as b from pos where i < len(w)) join g using (a, b)),
 near as (select s.doc_id, s.t, s.start, h.label, h.grams, h.spot, h.place from (select distinct doc_id, t, spot - place as start from h) s join h on h.doc_id = s.doc_id and h.t = s.t and h.spot - h.place between s.start and s.start + {licenses.DRIFT}),
 able as (select doc_id, t, start from near group by all having count(distinct place) >= {licenses.COVER} * any_value(grams)),
 c as (select near.* from near join able using (doc_id, t, start)),
 chain(doc_id, t, start, label, grams, spot, place, n) as (select doc_id, t, start, label, grams, spot, place, 1 from c
  union select k.doc_id, k.t, k.start, k.label, k.grams, c.spot, c.place, k.n + 1 from chain k join c on c.doc_id = k.doc_id and c.t = k.t and c.start = k.start and c.spot > k.spot and c.place > k.place),
 found as (select doc_id, label, max(n) / any_value(grams)::double as cover from chain group by doc_id, t, start, label having max(n) >= {licenses.COVER} * any_value(grams)
  union all select doc_id, label, 1.0 from base),
 f as (select doc_id, string_agg(distinct label, ',' order by label) as labels, max(cover) as score from found group by doc_id),
 n as (select doc_id, count(*) as n_base, min(first) as first_word, max(first) as last_word, string_agg(distinct label, ',' order by label) as base_labels from base group by doc_id)
 select d.doc_id, len(d.w)::bigint as n_words, coalesce(n_base, 0) as n_base, first_word, last_word, coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0.0)::double as score from d left join n on n.doc_id = d.doc_id left join f on f.doc_id = d.doc_id"""


AUDIT = r"""with d as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t from documents),
 w as (select *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w, min(doc_id) over (partition by t) as least from d),
 m as (select doc_id, part, (len(w) < 200)::int as a, (100 * list_unique(w) < 50 * len(w))::int as b, (100 * len(regexp_replace(t, '[^A-Z]+', '', 'g')) > 3 * len(t))::int as c,
  regexp_matches(t, '[#$%&*|]')::int as d, coalesce(doc_id > least, false)::int as e from w),
 l as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as bad from labels group by 1),
 c as (select part, [a, b, c, d, e] as f, a + b + c + d + e as fails, count(*) as n, sum(coalesce(good, 0)) as good, sum(coalesce(bad, 0)) as bad from m left join l using (doc_id) group by all),
 f as (select unnest([1, 2, 3, 4, 5]) as k),
 o as (select [p.k, q.k, r.k, s.k, t.k] as o from f p, f q, f r, f s, f t where len(list_distinct([p.k, q.k, r.k, s.k, t.k])) = 5),
 x as (select o, array_to_string(list_transform(o, lambda k: chr((64 + k)::int)), '') as filter_order, unnest(range(1, 6)) as step from o),
 y as (select part, filter_order, step, n, good, bad, fails, f[o[step]] = 1 as own, coalesce(list_sum(list_transform(o[1:step - 1], lambda k: f[k])), 0) > 0 as before from c, x)
 select part, filter_order, step::int as step, coalesce(sum(n) filter (not own and not before), 0)::bigint as kept, coalesce(sum(n) filter (own and not before), 0)::bigint as removed,
  coalesce(sum(n) filter (own and before), 0)::bigint as redundant, coalesce(sum(n) filter (own and fails = 1), 0)::bigint as unique_fails, coalesce(sum(good) filter (own and not before), 0)::bigint as good_lost,
  coalesce(sum(bad) filter (own and not before), 0)::bigint as toxic_lost, coalesce(sum(n * (120 // greatest(fails, 1))) filter (own), 0)::bigint as shapley from y group by all"""


def codes_sql(parts: int = 4, rounds: int = 4) -> str:
    """Every round as a statement of its own: all distances, the nearest entry, the floors of the means."""
    floor = "(s[k] - ((s[k] % n) + n) % n) // n"
    near = """select i, p, arg_min(e, (d, e)) as e, min(d) as d from (select x.i, x.p, b.e, list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as d from x join b{r} b using (p)) group by i, p"""
    steps = [f"a{r} as materialized ({near.format(r=r)})" for r in range(rounds + 1)]
    means = [
        f"""b{r + 1} as materialized (select p, b{r}.e, coalesce(m.v, b{r}.v) as v from b{r} left join (select p, e, list_transform(range(1, len(s) + 1), lambda k: {floor}) as v
  from (select p, e, list(t order by k) as s, any_value(n) as n from (select p, e, k, sum(c)::bigint as t, count(*) as n from (select a.p, a.e, unnest(x.v) as c, unnest(range(1, len(x.v) + 1)) as k from a{r} a join x using (i, p)) group by p, e, k) group by p, e)) m using (p, e))"""
        for r in range(rounds)
    ]
    chain = ", ".join(s for r in range(rounds) for s in (steps[r], means[r])) + ", " + steps[rounds]
    return f"""with u as (select vec_id, label, row_number() over (order by vec_id) as i, list_transform(embedding, lambda c: floor(1024 * c::double)::bigint) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0),
 x as materialized (select i, p, v[p * (len(v) // {parts}) + 1:(p + 1) * (len(v) // {parts})] as v from (select i, v, unnest(range({parts})) as p from u)),
 b0 as materialized (select p, i - 1 as e, v from x where i <= 256), {chain},
 h as (select sha256(string_agg(array_to_string(v, ','), ',' order by p, e)) as h from b{rounds}),
 g as (select i, string_agg(lpad(to_hex(e), 2, '0'), '' order by p) as code, sum(d)::bigint as error from a{rounds} group by i)
 select vec_id, lower(code) as code, error, sum(error) over (partition by label)::bigint as label_error, h as codebooks_sha256 from u join g using (i), h"""


ORACLES = {"op3_license_scan": license_sql(), "op6_ngram_jaccard": JACCARD, "op11_filter_audit": AUDIT, "op13_vector_codes": codes_sql()}
