"""SQL that gives the rows of the operators' queries, for those that SQL can express."""

from __future__ import annotations

from . import fingerprint as G
from . import rules as R
from . import simhash

WORD = r"[^\x20\x09-\x0D]+"
_TEXTS = "select doc_id, coalesce(text, '') as text from documents"
_STOP_WORDS = ", ".join(f"'{w.decode()}'" for w in sorted(R.STOP_WORDS))
_BITS = " + ".join(f"case when {r.failed} then {1 << r.bit} else 0 end" for r in R.RULES)
_RULE_NAMES = " ".join(f"when {1 << r.bit} then '{r.name}'" for r in R.RULES)
_N = G.BUCKETS
_KEYS = ", ".join(f"b + 256 * lead(b, {i}) over o + 65536 * lead(b, {j}) over o + {s << 24}" for s, (i, j) in enumerate(G.TRIPLETS))
_APART = "list_sum([case abs({0}[z] - {1}[z]) when 3 then 6 else abs({0}[z] - {1}[z]) end for z in range(1, {2})])"

_OP1 = rf"""
with d as ({_TEXTS}),
x as (select doc_id, text, coalesce(lead(text) over o, first_value(text) over o) as follows, coalesce(lead(doc_id) over o, first_value(doc_id) over o) as next_id from d window o as (order by doc_id desc)),
y as (select doc_id, next_id, text, length(text) as n, left(text, length(text) - length(text) // 3) || left(follows, length(text) // 3) as edited from x),
e as (select doc_id, 0 as which, encode(text) as raw from y union all select doc_id, 1, encode(edited) from y),
p as (select doc_id, which, unnest(range(1, strlen(h) // 2 + 1)) as i, unnest([('0x' || z)::bigint for z in regexp_extract_all(h, '..')]) as b from (select doc_id, which, hex(raw) as h from e)),
t as (select doc_id, which, unnest([{_KEYS}]) as k from p window o as (partition by doc_id, which order by i)),
h as (select doc_id, which, (xor(k, k >> 15) * {0x2C1B3C6D}) & 4294967295 as k from t where k is not null),
c as (select doc_id, which, ((xor(k, k >> 12) * {0x297A2D39}) & 4294967295) >> {33 - _N.bit_length()} as bucket, count(*) as n from h group by all),
a as (select doc_id, which, octet_length(raw) as size, list(coalesce(n, 0) order by v.bucket) as cs from e cross join (select unnest(range({_N})) as bucket) v left join c using (doc_id, which, bucket) group by all),
s as (select doc_id, which, size, cs, list_sort(cs)[{_N // 4}] as q1, list_sort(cs)[{_N // 2}] as q2, list_sort(cs)[{3 * _N // 4}] as q3 from a),
g as (select doc_id, which, least(255, round(8 * log2(1 + size)))::bigint as l, q1 * 15 // greatest(q3, 1) as r1, q2 * 15 // greatest(q3, 1) as r2, [(z > q1)::int + (z > q2)::int + (z > q3)::int for z in cs] as code from s),
f as (select doc_id, which, l, r1, r2, code, printf('%02x%02x', l, 16 * r1 + r2) || array_to_string([printf('%02x', code[z] + 4 * code[z + 1] + 16 * code[z + 2] + 64 * code[z + 3]) for z in range(1, {_N}, 4)], '') as digest from g),
n as (select y.*, o.digest as fingerprint, w.digest as edited_fingerprint, o.code as oc, w.code as wc, t.code as tc, abs(o.l - w.l) + abs(o.r1 - w.r1) + abs(o.r2 - w.r2) as wh, abs(o.l - t.l) + abs(o.r1 - t.r1) + abs(o.r2 - t.r2) as th
  from y join f o on o.doc_id = y.doc_id and o.which = 0 join f w on w.doc_id = y.doc_id and w.which = 1 join f t on t.doc_id = next_id and t.which = 0)
select doc_id, n as n_chars, sha256(edited) as edited_sha256, fingerprint, edited_fingerprint,
  1.0::double - ({_APART.format('oc', 'wc', _N + 1)} + least(wh, {G.HEAD_CAP}))::double / {6 * _N + G.HEAD_CAP} as near_edited,
  1.0::double - ({_APART.format('oc', 'tc', _N + 1)} + least(th, {G.HEAD_CAP}))::double / {6 * _N + G.HEAD_CAP} as near_next from n"""

_OP2 = r"""
with p as (select page_id, coalesce(html, '') as body from pages),
d as (select page_id, strlen(body) as payload_bytes, body, sha1(body) as h, max(page_id) over (partition by body) as first from p)
select page_id, payload_bytes, array_to_string([('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567')[((('0x' || substr(h, 5 * (i // 4) + 1, 5))::bigint >> (15 - 5 * (i % 4))) & 31) + 1] for i in range(32)], '') as payload_digest,
  case when page_id = first then 'response' else 'revisit' end as record_type, case when page_id <> first then first end as refers_to from d"""

_OP3 = r"""
with w as (select doc_id, encode(coalesce(text, '')) as b from documents),
p as (select doc_id, unnest(range(1, octet_length(b) + 1)) as i, b from w),
k as (select doc_id, i, b[i:i] as byte, case when i <= octet_length(b) - 49 then b[i:i + 49] end as win from p),
f as (select win, min(doc_id) as first from k where win is not null group by win),
c as (select doc_id, i, byte, bool_or(coalesce(first < doc_id, false)) over (partition by doc_id order by i rows between 49 preceding and current row) as gone from k left join f using (win)),
e as (select *, gone and not coalesce(lag(gone) over (partition by doc_id order by i), false) as opens from c),
s as (select doc_id, count(*) filter (gone) as n_removed, count(*) filter (opens) as n_spans, unhex(string_agg(hex(byte), '' order by i) filter (not gone)) as kept from e group by doc_id)
select doc_id, octet_length(b) as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(coalesce(kept, ''::blob)) as kept_sha256 from w left join s using (doc_id)"""

_OP5 = rf"""
with t as (select doc_id, text, regexp_extract_all(text, '{WORD}') as ws from ({_TEXTS})),
l as (select *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')) as ls from t),
g as (select doc_id, unnest(range(1, len(ws) + 1)) as i, unnest([case when j <= len(ws) - 2 then ws[j:j + 2] end for j in range(1, len(ws) + 1)]) as three from t),
a as (select doc_id, i, three is not null and count(*) over (partition by doc_id, three) > 1 as again from g),
c as (select doc_id, i, bool_or(again) over (partition by doc_id order by i rows between 2 preceding and current row) as again from a),
r as (select doc_id, count(*) filter (again) as n_repeat_words from c group by doc_id),
m as (select doc_id, len(ws) as n_words, coalesce(list_sum([length(w) for w in ws]), 0)::bigint as word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols,
  len(ls) - len(list_distinct(ls)) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words, len(ls) as n_lines, strlen(text) as n_bytes,
  len([w for w in regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') if w in ({_STOP_WORDS})]) as n_stop,
  len([w for w in regexp_extract_all(regexp_replace(text, '[.,;:!?''"()-]', '', 'g'), '{WORD}') if regexp_full_match(w, '([A-Za-z]|[^\x00-\x7F])+')]) as n_alpha_words,
  len([w for w in ws if regexp_matches(w, '[A-Z]') and not regexp_matches(w, '[a-z]')]) as n_upper_words,
  coalesce(list_sum([strlen(x) for x in ls]), 0) - coalesce(list_sum([strlen(x) for x in list_distinct(ls)]), 0) as n_dup_line_bytes from l left join r using (doc_id)),
e as (select *, {_BITS} as failed_bits from m),
v as (select *, failed_bits & {R.POLICIES['v2']} as mask from e),
o as (select mask as sole, count(*) as n_sole from v where mask > 0 and mask & (mask - 1) = 0 group by mask)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed_bits & {R.BASE} <> 0 as base_failed, mask = 0 and failed_bits & {R.BASE} = 0 as kept, failed_bits::bigint as failed_bits,
  failed_bits & {R.POLICIES['v1']} = 0 as kept_v1, case mask {_RULE_NAMES} end as sole_rule, n_sole from v left join o on sole = mask"""

_OP7 = rf"""
with t as (select doc_id, text, string_split(text, chr(10)) as ls from documents where text is not null),
l as (select doc_id, unnest(range(len(ls))) as line, unnest(ls) as body from t),
w as (select doc_id, line, body, list_sort(list_distinct(regexp_extract_all(body, '{WORD}'))) as ws from l),
s as (select ws, min({{'d': doc_id, 'l': line}}) as first from w where len(ws) > 0 group by ws),
n as (select row_number() over () as num, ws, first, len(ws) as n from s),
u as (select num, n, first, unnest(ws) as word from n),
f as (select word, count(*) as df from u group by word),
p as (select num, n, first, word, row_number() over (partition by num order by df, word) as place from u join f using (word)),
q as (select num, n, first, word from p where place <= n - (4 * n + 4) // 5 + 1),
c as (select distinct y.num as y, x.num as x from q y join q x on y.word = x.word and x.first < y.first and 5 * x.n >= 4 * y.n and 5 * y.n >= 4 * x.n),
m as (select distinct y as num from c join n a on a.num = y join n b on b.num = x where 9 * len(list_intersect(a.ws, b.ws)) >= 4 * (a.n + b.n)),
g as (select w.doc_id, w.line, w.body, n.num is not null and (m.num is not null or n.first < {{'d': w.doc_id, 'l': w.line}}) as gone from w left join n using (ws) left join m using (num)),
k as (select doc_id, count(*) filter (gone) as n_removed, string_agg(body, chr(10) order by line) filter (not gone) as kept from g group by doc_id)
select doc_id, coalesce(len(ls), 0) as n_lines, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from documents left join t using (doc_id) left join k using (doc_id)"""

_OP9 = rf"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') as ws from documents),
k as (select doc_id, unnest(range(1, len(ws) + 1)) as i, unnest(ws) as word, unnest([case when j <= len(ws) - 49 then array_to_string(ws[j:j + 49], ' ') end for j in range(1, len(ws) + 1)]) as win from w),
f as (select win, min(doc_id) as first from k where win is not null group by win),
c as (select doc_id, i, word, bool_or(coalesce(first < doc_id, false)) over (partition by doc_id order by i rows between 49 preceding and current row) as gone from k left join f using (win)),
s as (select doc_id, count(*) filter (gone) as n_removed, string_agg(word, ' ' order by i) filter (not gone) as kept from c group by doc_id)
select doc_id, len(ws) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from w left join s using (doc_id)"""

_SIZE = "18446744073709551616::uhugeint"
#: The primes of XXH64.
_P = (0, 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)


def _times(x: str, prime: int) -> str:
    return f"({x}) * {_P[prime]}::uhugeint % {_SIZE}"


def _turned(x: str, by: int) -> str:
    return f"({x} * {1 << by}::uhugeint % {_SIZE} + {x} // {1 << (64 - by)}::uhugeint)"


def _lane(at: str, n: int) -> str:
    """``n`` bytes from ``at`` of a text whose bytes are ``x`` in hex, the first the least."""
    return "('0x' || " + " || ".join(f"substr(x, 2 * ({at} + {i}) + 1, 2)" for i in range(n - 1, -1, -1)) + ")::ubigint::uhugeint"


_FOUR = range(1, 5)
_START = (simhash.SEED + _P[1] + _P[2], simhash.SEED + _P[2], simhash.SEED, simhash.SEED - _P[1])
_MERGED = "m0"
for _i in _FOUR:
    _MERGED = f"({_times(f'xor({_MERGED}, r{_i})', 1)} + {_P[4]}::uhugeint) % {_SIZE}"
_OP10 = rf"""
with recursive w as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') as ws from ({_TEXTS})),
g as (select doc_id, unnest(case when len(ws) = 0 then [] when len(ws) < 3 then [array_to_string(ws, ' ')] else [array_to_string(ws[i:i + 2], ' ') for i in range(1, len(ws) - 1)] end) as s from w),
d as (select s, strlen(s) as n, hex(encode(s)) as x from (select distinct s from g)),
stripes as (select s, x, n, 0::bigint as pos, {', '.join(f'{v % (1 << 64)}::uhugeint as v{i}' for i, v in zip(_FOUR, _START))} from d where n >= 32
  union all select s, x, n, pos + 32, {', '.join(_times(_turned(f'a{i}', 31), 1) for i in _FOUR)} from (select s, x, n, pos, {', '.join(f"(v{i} + {_times(_lane(f'pos + {8 * i - 8}', 8), 2)}) % {_SIZE} as a{i}" for i in _FOUR)} from stripes where pos + 32 <= n)),
turned as (select s, x, n, pos, ({' + '.join(_turned(f'v{i}', r) for i, r in zip(_FOUR, (1, 7, 12, 18)))}) % {_SIZE} as m0, {', '.join(f'{_times(f"v{i}", 2)} as q{i}' for i in _FOUR)} from stripes where pos + 32 > n),
merged as (select s, x, n, pos, {_MERGED} as h from (select *, {', '.join(f'{_times(_turned(f"q{i}", 31), 1)} as r{i}' for i in _FOUR)} from turned)),
tail as (select s, x, n, pos, (h + n::uhugeint) % {_SIZE} as h from (select * from merged union all select s, x, n, 0, {simhash.SEED + _P[5]}::uhugeint from d where n < 32)
  union all select s, x, n, pos + k, case k when 8 then ({_times(_turned('e', 27), 1)} + {_P[4]}::uhugeint) % {_SIZE} when 4 then ({_times(_turned('e', 23), 2)} + {_P[3]}::uhugeint) % {_SIZE} else {_times(_turned('e', 11), 1)} end
  from (select s, x, n, pos, k, xor(h, case k when 8 then {_times(_turned('l', 31), 1)} else l end) as e from (select s, x, n, pos, h, k, case k when 8 then {_times(_lane('pos', 8), 2)} when 4 then {_times(_lane('pos', 4), 1)} else {_times(_lane('pos', 1), 5)} end as l
    from (select *, case when pos + 8 <= n then 8 when pos + 4 <= n then 4 else 1 end as k from tail where pos < n)))),
a1 as (select s, {_times('xor(h, h // 8589934592::uhugeint)', 2)} as h from tail where pos = n),
a2 as (select s, {_times('xor(h, h // 536870912::uhugeint)', 3)} as h from a1),
k as (select s, xor(h, h // 4294967296::uhugeint)::ubigint as h from a2),
f as (select doc_id, {' + '.join(f"case when 2 * sum((h >> {b}) & 1) > count(*) then {1 << b}::ubigint else 0::ubigint end" for b in range(64))} as fp from g join k using (s) group by doc_id),
o as (select doc_id, coalesce(fp, 0::ubigint) as fp from w left join f using (doc_id)),
p as (select fp, min(doc_id) as first from o group by fp),
j as (select a, b from (select a.fp as a, b.fp as b, xor(a.fp, b.fp) as c from p a, p b where a.fp <> b.fp) where bit_count((c >> 32)::bigint) + bit_count((c & 4294967295)::bigint) <= 2),
r as (select fp, first from p union select b, first from r join j on a = fp)
select doc_id, format('{{:016x}}', fp) as fingerprint, component_id from o join (select fp, min(first) as component_id from r group by fp) using (fp)"""

ORACLE = {
    "op1_bucket_digest": _OP1,
    "op2_warc_segments": _OP2,
    "op3_front_coded_suffix_runs": _OP3,
    "op5_rule_ledger": _OP5,
    "op7_line_similarity_join": _OP7,
    "op9_prefix_subtrees": _OP9,
    "op10_pigeonring_simhash": _OP10,
}
