"""SQL that gives the same rows as the numbered queries, where SQL can say it."""

from kinotable.llm.decontamination import ORACLE as DECONTAMINATION

_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _LOW + ", '[^\\x20\\x09-\\x0D]+')"

JACCARD = f"""
with recursive w as (select doc_id, coalesce({_WORDS.format("text")}, []) w from documents),
s as (select doc_id, list_distinct(case when len(w) >= 3 then list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) s from w),
e as (select doc_id, hash(x) h from (select doc_id, unnest(s) x from s)),
p as (select a.doc_id a, b.doc_id b, count(*) c from e a join e b on a.h = b.h and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
l as (select a, b from p join s x on x.doc_id = a join s y on y.doc_id = b where 100 * c >= 90 * (len(x.s) + len(y.s) - c)),
near as (select a, b from l union all select b, a from l),
r as (select doc_id, doc_id root from s union select r.doc_id, near.b from r join near on near.a = r.root)
select doc_id, cast(len(s) as bigint) n_shingles, least_root component_id from s join (select doc_id, min(root) least_root from r group by doc_id) using (doc_id)
"""

SUFFIXES = """
with t as (select doc_id, hex(encode(coalesce(text, ''))) h from documents),
n as (select doc_id, h, cast(length(h) // 2 as bigint) n from t),
b as (select doc_id, n, k, substr(h, 2 * k + 1, 2 * 1099) piece from (select *, unnest(range(0, greatest(n - 99, 0), 1000)) k from n)),
p as (select doc_id, k + j i, md5_number(substr(piece, 2 * j + 1, 200)) m from (select *, unnest(range(0, least(1000, n - 99 - k))) j from b)),
a as (select doc_id, i from (select doc_id, i, row_number() over (partition by m order by doc_id, i) place from p) where place > 1),
g as (select doc_id, i, sum(fresh) over (partition by doc_id order by i) run from (select doc_id, i, case when i - lag(i) over (partition by doc_id order by i) <= 100 then 0 else 1 end fresh from a)),
r as (select doc_id, min(i) s, max(i) + 100 e from g group by doc_id, run),
c as (select doc_id, s, e, coalesce(lag(e) over (partition by doc_id order by s), 0) before from r),
k as (select doc_id, string_agg(substr(h, cast(2 * before + 1 as bigint), cast(2 * (s - before) as bigint)), '' order by s) kept, max(e) last, cast(sum(e - s) as bigint) gone, count(*) spans from c join n using (doc_id) group by doc_id)
select doc_id, n n_bytes, coalesce(gone, 0) n_removed, coalesce(spans, 0) n_spans, sha256(unhex(coalesce(kept, '') || substr(h, cast(2 * coalesce(last, 0) + 1 as bigint)))) kept_sha256 from n left join k using (doc_id)
"""

LINES = f"""
with x as (select doc_id, string_split(text, chr(10)) x from documents),
l as (select doc_id, unnest(x) line, generate_subscripts(x, 1) - 1 line_no from x),
s as (select doc_id, line_no, list_sort(list_distinct({_WORDS.format("line")})) s from l),
d as (select s, d0, l0, row_number() over (order by d0, l0) nid from (select s, min(doc_id) d0, min_by(line_no, (doc_id, line_no)) l0 from s where len(s) > 0 group by s)),
w as (select nid, len(s) n, unnest(s) w from d),
f as (select w, count(*) c from w group by w),
o as (select nid, n, w, row_number() over (partition by nid order by c, w) r from w join f using (w)),
p as (select nid, n, w from o where r <= n - (n * 80 + 99) // 100 + 1),
c as (select distinct x.nid x, y.nid y from p x join p y on x.w = y.w and x.nid < y.nid and 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)),
v as (select y, len(a.s) n, len(b.s) m, len(list_intersect(a.s, b.s)) c from c join d a on a.nid = c.x join d b on b.nid = c.y),
gone as (select distinct y nid from v where 100 * c >= 80 * (n + m - c)),
r as (select s.doc_id, s.line_no from s join d using (s) left join gone using (nid) where gone.nid is not null or s.doc_id <> d0 or s.line_no <> l0),
q as (select doc_id, count(*) n, string_agg(cast(line_no as varchar), ',' order by line_no) t from r group by doc_id)
select doc_id, cast(coalesce(len(x), 0) as bigint) n_lines, coalesce(n, 0) n_removed, coalesce(t, '') removed_lines from x left join q using (doc_id)
"""

MIDDLES = """
with h as (select doc_id, coalesce(text, '') t, sha256('1:' || coalesce(cast(doc_id as varchar), '')) h from documents),
w as (select *, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') w, list_transform([0, 1, 2, 3], lambda i: cast('0x' || substr(h, 8 * i + 1, 8) as bigint)) r from h),
c as (select doc_id, t, w, len(w) n, r[1] % (len(w) + 1) x, r[2] % (len(w) + 1) y, case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or r[3] % 100 >= 90 then 'plain' when r[4] % 100 < 20 then 'spm' else 'psm' end form from w),
p as (select *, array_to_string(w[1:least(x, y)], '') p, array_to_string(w[least(x, y) + 1:greatest(x, y)], '') m, array_to_string(w[greatest(x, y) + 1:], '') s from c)
select doc_id, cast(n as bigint) n, form, case when form <> 'plain' then length(p) end prefix_chars, case when form <> 'plain' then length(m) end middle_chars,
sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) output_sha256, sha256(t) restored_sha256 from p
"""

ORACLES: dict[str, str] = {"op1_ngram_jaccard_join": JACCARD, "op5_suffix_dedup": SUFFIXES, "op7_line_dedup": LINES, "op9_decontamination": DECONTAMINATION, "op11_fill_in_middle": MIDDLES}
