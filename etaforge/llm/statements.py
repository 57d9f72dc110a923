"""DuckDB statements of the dealt operators that SQL can express."""

from __future__ import annotations

# DuckDB has no crc32: a table of the 256 single bytes by rule, and a fold over a value's bytes.
CRC_TABLE = """crc_table as (select list_transform(range(256), lambda i: list_reduce(
  [i::bigint, 0, 0, 0, 0, 0, 0, 0, 0],
  lambda c, _: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as crcs)"""


def crc32(value: str) -> str:
    """Unsigned crc32 of a text expression, where `crcs` of crc_table is in scope."""
    octets = f"list_transform(range(1, 2 * octet_length(encode({value})), 2), lambda i: ('0x' || substr(hex(encode({value})), i, 2))::bigint)"
    fold = f"list_reduce(list_concat([4294967295::bigint], {octets}), lambda c, b: xor(crcs[(xor(c, b) & 255) + 1], c >> 8))"
    return f"xor({fold}, 4294967295)"


LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = rf"regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

IMPORTANCE = rf"""with {CRC_TABLE},
texts as (
  select doc_id, {WORDS} as ws, true as raw from documents
  union all select null, {WORDS}, false from benchmark),
words as (select distinct unnest(ws) as w from texts),
hashed as (select w, {crc32('w')} % 10000 as b from words, crc_table),
each as (select doc_id, raw, unnest(ws) as w from texts),
counts as (
  select b, count(*) filter (raw) as s, count(*) filter (not raw) as t from each join hashed using (w) group by b),
gains as (
  select b, floor(1000 * ln((t + 1.0::double) * (sum(s) over () + 10000)::double
    / ((s + 1.0::double) * (sum(t) over () + 10000)::double)))::bigint as gain from counts),
summed as (
  select doc_id, sum(gain)::bigint as total from each join hashed using (w) join gains using (b) where raw group by doc_id),
weighed as (
  select doc_id, len(ws)::bigint as n_features,
    coalesce(floor(total::double / len(ws)), 0)::bigint as weight,
    ('0x' || substr(sha256('2024:' || doc_id::varchar), 1, 8))::bigint as h
  from texts left join summed using (doc_id) where raw),
scored as (
  select *, weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296.0::double)))::bigint as score from weighed),
placed as (
  select *, row_number() over (partition by n_features >= 20 order by score desc, doc_id) as place,
    count(*) filter (n_features >= 20) over () as n from scored)
select doc_id, n_features, weight, score,
  case when n_features >= 20 and place <= (10 * n) // 100 then place end::bigint as rank
from placed"""

SPELLING = rf"""with recursive {CRC_TABLE},
runs as (
  select doc_id, unnest(regexp_extract_all({LOWER}, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) as r from documents),
long_runs as (select doc_id::varchar || ':' || r as k, r from runs where length(r) >= 7),
hashed as (select r, {crc32('k')} as h from long_runs, crc_table),
spelt as (
  select case when h % 31 = 0 then substr(r, 1, (h % length(r))::int) || substr(r, (h % length(r))::int + 2) else r end as word
  from hashed),
words as (select word, count(*) as n from spelt where length(word) >= 7 group by word having count(*) >= 2),
gaps as (
  select word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) as rest
  from (select word, n, unnest(range(1, length(word) + 1)) as i from words)),
near as (
  select distinct a.word, b.word as near, b.n as near_n from gaps a join gaps b on a.i = b.i and a.rest = b.rest and a.word <> b.word
  union select a.word, b.word, b.n from gaps a join words b on a.rest = b.word
  union select b.word, a.word, a.n from gaps a join words b on a.rest = b.word),
best as (
  select word, count(*) as n_near, arg_min(near, (-near_n, near)) as near, max(near_n) as near_n from near group by word),
formed as (
  select w.word, w.n, coalesce(n_near, 0) as n_near, case when near_n >= 10 * w.n then near end as form,
    case when near_n >= 10 * w.n then near_n end as form_n
  from words w left join best b on w.word = b.word),
chain as (
  select word, word as root, form as up from formed
  union all select c.word, c.up, f.form from chain c join formed f on f.word = c.up)
select f.word, f.form, c.root, f.n::bigint as n, f.n_near::bigint as n_near, f.form_n::bigint as form_n
from formed f join chain c on c.word = f.word and c.up is null"""

STATEMENTS = {"op11_importance_resampling": IMPORTANCE, "op13_spelling_variants": SPELLING}
