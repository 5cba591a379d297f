"""DuckDB SQL for the queries that SQL can express, by plain counting and comparing."""

from __future__ import annotations

from nearkin.llm.merkle import FIELDS
from nearkin.llm.quality_rules import BASE, LONG_WORD, RULES, STOP_WORDS, SYMBOLS, WINDOW, Rule


def _failing(rule: Rule) -> str:
    value, bounds = f"({rule.value})", []
    if rule.per:
        value += f" / nullif({rule.per}, 0)"
    if rule.low is not None:
        bounds.append(f"{value} < {rule.low}")
    if rule.high is not None:
        bounds.append(f"{value} > {rule.high}")
    return f"coalesce({' or '.join(bounds)}, false)"


def quality_rules() -> str:
    space = r"\x20\x09-\x0D"
    stop = ", ".join(f"'{w}'" for w in sorted({w for words in STOP_WORDS.values() for w in words}))
    base = " or ".join(_failing(r) for r in BASE)
    every = " or ".join(_failing(r) for r in (*BASE, *RULES))
    return f"""
with d as (select doc_id, coalesce(text, '') as t from documents),
w as (select doc_id, t, regexp_extract_all(t, '[^{space}]+') as ws,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{space}]')) as ls from d),
g as (select doc_id, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') as g
  from (select doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) as i from w)),
r as (select doc_id, count(distinct p) as n from (select doc_id, unnest(range(i, i + {WINDOW})) as p
  from (select *, count(*) over (partition by doc_id, g) as c from g) where c > 1) group by doc_id),
s as (select doc_id, len(ws) as n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::bigint as word_chars,
  length(t) - length(regexp_replace(t, '[{SYMBOLS}]', '', 'g')) as n_symbols,
  len(ls) as n_lines, len(ls) - len(list_distinct(ls)) as n_dup_lines, coalesce(r.n, 0) as n_repeat_words,
  len(list_filter(ws, lambda x: length(x) > {LONG_WORD})) as n_long_words,
  len(list_filter(ws, lambda x: lower(trim(x, '.,;:!?')) in ({stop}))) as n_stop_words,
  len(list_filter(ws, lambda x: regexp_matches(x, '\\p{{L}}'))) as n_letter_words,
  len(list_filter(ws, lambda x: upper(x) = x and lower(x) <> x)) as n_capital_words
  from w left join r using (doc_id)),
f as (select *, {base} as base_failed, {every} as any_failed from (
  select doc_id, {', '.join(f'{c}::double as {c}' for c in ('n_words', 'word_chars', 'n_symbols', 'n_lines', 'n_dup_lines', 'n_repeat_words', 'n_long_words', 'n_stop_words', 'n_letter_words', 'n_capital_words'))} from s)
)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols,
  n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words, base_failed, not any_failed as kept from f
"""


def substrings(length: int = 100) -> str:
    # Bytes as hexadecimal digits, two each.
    n = 2 * length
    return f"""
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
w as (select doc_id, p, substr(h, 2 * p + 1, {n}) as g
  from (select doc_id, h, unnest(range(0, length(h) // 2 - {length - 1})) as p from d)),
again as (select doc_id, p from (select doc_id, p, row_number() over (partition by g order by doc_id, p) as k from w) where k > 1),
runs as (select doc_id, p, case when p <= lag(p) over (partition by doc_id order by p) + {length} then 0 else 1 end as new from again),
spans as (select doc_id, min(p) as a, max(p) + {length} as b from (
  select *, sum(new) over (partition by doc_id order by p) as run from runs) group by doc_id, run),
gaps as (select doc_id, a, b, coalesce(lag(b) over (partition by doc_id order by a), 0) as kept_from from spans),
kept as (select doc_id, sum(b - a) as n_removed, count(*) as n_spans, max(b) as done,
  string_agg(substr(h, 2 * kept_from + 1, 2 * (a - kept_from)), '' order by a) as head from gaps join d using (doc_id) group by doc_id)
select doc_id, length(h) // 2 as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans,
  sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(done, 0) + 1))) as kept_sha256
from d left join kept using (doc_id)
"""


def merkle(fields: tuple[str, ...] = FIELDS) -> str:
    def leaf(text: str) -> str:
        parts = [text if f == "text" else f"{f}::varchar" for f in fields]
        return "sha256(" + " || ".join(f"coalesce(strlen({p})::varchar || ':' || {p}, '-')" for p in parts) + ")"

    # CRC-32 bit by bit: DuckDB has no function for it.
    shift = "list_reduce(list_prepend(xor(c, b), range(8)), lambda r, i: xor(r >> 1, 3988292384 * (r & 1)))"
    crc = f"xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint)), lambda c, b: {shift}))"
    return f"""
with recursive l as (select doc_id, source, {leaf('text')} as leaf, {leaf('tampered')} as found from (
  select *, case when {crc} % 2 = 0 then replace(text, chr(10), '') else text end as tampered from documents)),
p as (select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by source) as n from l),
nodes as (
  select 0 as level, source, pos, n, leaf as hash from p
  union all
  select level + 1, source, pos // 3, (n + 2) // 3, sha256(string_agg(hash, '' order by pos)) from nodes where n > 1 group by all),
subs as (select source, hash as subroot, row_number() over (order by source nulls first) - 1 as spos, count(*) over () as sn from nodes where n = 1),
tops as (
  select 0 as level, spos as pos, sn as n, subroot as hash from subs
  union all
  select level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(hash, '' order by pos)) from tops where n > 1 group by all),
around as (
  select 'node' as kind, level, coalesce('+' || source, '') as tree, pos, string_agg(hash, '' order by pos) over (partition by level, source, pos // 3
    order by pos rows between unbounded preceding and 1 preceding) as before, string_agg(hash, '' order by pos) over (partition by level, source, pos // 3
    order by pos rows between 1 following and unbounded following) as after from nodes
  union all
  select 'top', level, '', pos, string_agg(hash, '' order by pos) over (partition by level, pos // 3 order by pos rows between unbounded preceding and 1 preceding),
    string_agg(hash, '' order by pos) over (partition by level, pos // 3 order by pos rows between 1 following and unbounded following) from tops),
ways as (
  select 0 as level, case when p.n > 1 then 'node' else 'top' end as kind, coalesce('+' || p.source, '') as tree, p.doc_id, p.leaf, s.subroot, s.spos, s.sn,
    case when p.n > 1 then p.pos else s.spos end as pos, case when p.n > 1 then p.n else s.sn end as n, p.found as folded, '' as proof
  from p join subs s on p.source is not distinct from s.source
  union all
  select case when up then 0 else level + 1 end, case when up then 'top' else kind end, tree, doc_id, leaf, subroot, spos, sn,
    case when up then spos else pos // 3 end, case when up then sn else (n + 2) // 3 end,
    sha256(coalesce(before, '') || folded || coalesce(after, '')), proof || coalesce(before, '') || coalesce(after, '')
  from (select w.*, a.before, a.after, w.kind = 'node' and w.n <= 3 as up from ways w
    join around a on a.kind = w.kind and a.level = w.level and a.pos = w.pos and a.tree = case when w.kind = 'top' then '' else w.tree end where w.n > 1))
select doc_id, leaf, subroot, root, sha256(proof) as proof_sha256, folded as folded_root, folded = root as verified
from ways, (select hash as root from tops where n = 1) where n = 1 and kind = 'top'
"""


def queries() -> dict[str, str]:
    return {"op5_quality_rules": quality_rules(), "op8_substrings": substrings(), "op12_merkle": merkle()}
